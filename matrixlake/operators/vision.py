"""From a gray frame to module matrices: binarisation, finder patterns, geometry, sampling. numpy on one frame."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np

from ..functions.tables import size_of
from .codec import DecodeError, decode, read_version

#: Limits of the detector. Of frames, of finder profiles and of their two directions.
FLAT, TINY, PROFILE, AXES = 16, 48, 0.25, 1.6
#: Of triples, that is patterns looked at, spread of their modules, modules between centres, difference of
#: the legs and cosine of the corner.
MOST_PATTERNS, SPREAD, SPACING, IMBALANCE, COSINE = 12, 0.5, (9, 185), 0.6, 0.5
#: Of symbols, that is agreement of the timing patterns, modules that an estimate may be off, least pivot.
TIMING, SLACK, PIVOT = 0.7, 2.5, 1e-12
#: Pixels that are turned gray at once.
STRIP = 1 << 14


def gray_of(data: bytes, width: int, height: int) -> np.ndarray:
    """Luma of an RGBA buffer; alpha is ignored."""
    if len(data) < 4 * width * height:
        raise DecodeError("frame", "the buffer is shorter than the frame")
    pixels, out = np.frombuffer(data, "<u4", width * height), np.empty(width * height, np.uint8)
    for at in range(0, len(pixels), STRIP):  # whole pixels, red lowest, in strips that stay in the cache
        p = pixels[at : at + STRIP]
        luma = (p & 255) * np.uint32(77)
        luma += (p >> 8 & 255) * np.uint32(150)
        luma += (p >> 16 & 255) * np.uint32(29)
        out[at : at + STRIP] = luma >> 8
    return out.reshape(height, width)


def downscale(gray: np.ndarray, factor: int) -> np.ndarray:
    h, w = (s // factor for s in gray.shape)
    return (gray[: h * factor, : w * factor].reshape(h, factor, w, factor).sum((1, 3), dtype=np.uint32) // factor**2).astype(np.uint8)


def otsu(histogram: np.ndarray) -> int:
    """One above the middle of the levels that part the histogram best."""
    n, level = histogram.sum(), np.arange(256)
    below, mass = np.cumsum(histogram).astype(float), np.cumsum(histogram * level).astype(float)
    above = n - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where((below > 0) & (above > 0), below * above * (mass / below - (mass[-1] - mass) / above) ** 2, 0)
    best = np.flatnonzero(between == between.max())
    return int((best[0] + best[-1]) >> 1) + 1 if between.max() > 0 else 128


def window(n: int, boxes: int, tile: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of the boxes of two pixels around the middle of each tile of a side of n pixels."""
    middle = (np.arange(0, n, tile) + tile // 2) // 2
    return np.maximum(middle - half, 0), np.minimum(middle + half + 1, boxes)


def binarize(gray: np.ndarray) -> np.ndarray:
    """Dark pixels: below 7/8 of the mean of a window around their tile, or below half of the frame's own threshold."""
    h, w = gray.shape
    step = 1 if min(h, w) < TINY else 2
    histogram = np.bincount(gray[::step, ::step].ravel(), minlength=256)
    seen = np.flatnonzero(histogram)
    if not len(seen) or seen[-1] - seen[0] < FLAT:
        return np.zeros(gray.shape, bool)
    split = otsu(histogram)
    if min(h, w) < TINY:
        return gray < split
    half = int(min(40, max(8, np.floor(min(h, w) / 10 + 0.5))))
    rows, cols, tile = h // 2, w // 2, max(2, half // 8)
    pairs = gray[: 2 * rows : 2, : 2 * cols].astype(np.uint16) + gray[1 : 2 * rows : 2, : 2 * cols]
    sums = np.zeros((rows + 1, cols), np.int64)
    np.cumsum(pairs[:, ::2] + pairs[:, 1::2], 0, out=sums[1:])
    (y0, y1), (x0, x1) = window(h, rows, tile, half // 2), window(w, cols, tile, half // 2)
    bands = np.zeros((len(y0), cols + 1), np.int64)  # only the rows of tiles go on to the second sum
    np.cumsum(sums[y1] - sums[y0], 1, out=bands[:, 1:])
    pixels = 4 * (y1 - y0)[:, None] * (x1 - x0)
    cut = np.maximum(-(-7 * (bands[:, x1] - bands[:, x0]) // (8 * pixels)), split >> 1).astype(np.uint8)
    return gray < cut.repeat(tile, 1)[:, :w].repeat(tile, 0)[:h]


def profiles(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first column and length of the middle run, and span of every 1:1:3:1:1 window of runs."""
    h, w = bits.shape
    padded = np.zeros((h, w + 2), bool)
    padded[:, 1:-1] = bits
    flat = padded.ravel()
    edge = np.flatnonzero(flat[1:] != flat[:-1]) + 1  # rows end light, so edges come in pairs: dark from, light from
    row, at = edge // (w + 2), edge % (w + 2) - 1
    i = np.arange(0, len(edge) - 5, 2)
    i = i[row[i] == row[i + 5]] if len(i) else i
    runs = np.stack([at[i + k + 1] - at[i + k] for k in range(5)]).astype(float) if len(i) else np.zeros((5, 0))
    total = runs.sum(0)
    off = np.abs(runs - total * np.array([1, 1, 3, 1, 1])[:, None] / 7).sum(0)
    good = (total >= 7) & (off <= PROFILE * total)
    i = i[good]
    return row[i], at[i + 2], at[i + 3] - at[i + 2], total[good]


@dataclass
class Pattern:
    x: float
    y: float
    module: float
    count: int


def finder_patterns(bits: np.ndarray) -> list[Pattern]:
    """Places that show the finder profile along a row and along the column through it, seen twice at least."""
    col, top, tall, vspan = profiles(bits.T)
    cover = np.full(bits.shape, -1, np.int32)
    for k, (c, t, n) in enumerate(zip(col.tolist(), top.tolist(), tall.tolist(), strict=True)):
        cover[t : t + n, c] = k
    row, left, wide, hspan = profiles(bits)
    x = left + wide / 2
    hit = np.full(len(row), -1)
    for jitter in (0, -1, 1, -2, 2):
        c = np.clip(x.astype(int) + jitter, 0, bits.shape[1] - 1)
        hit = np.where(hit < 0, cover[row, c], hit)
    ok = hit >= 0
    ok[ok] = np.maximum(hspan[ok], vspan[hit[ok]]) <= AXES * np.minimum(hspan[ok], vspan[hit[ok]])
    sums: list[list[float]] = []
    for px, py, pm in zip(x[ok].tolist(), (top + tall / 2)[hit[ok]].tolist(), ((hspan[ok] + vspan[hit[ok]]) / 14).tolist(), strict=True):
        for s in sums:
            n = s[3]
            m = s[2] / n
            if abs(s[0] / n - px) <= m and abs(s[1] / n - py) <= m and abs(m - pm) <= 0.5 * m + 0.5:
                s[0], s[1], s[2], s[3] = s[0] + px, s[1] + py, s[2] + pm, n + 1
                break
        else:
            sums.append([px, py, pm, 1])
    return [Pattern(s[0] / s[3], s[1] / s[3], s[2] / s[3], int(s[3])) for s in sums if s[3] >= 2]


def ranked_triples(patterns: list[Pattern]) -> list[tuple[Pattern, Pattern, Pattern]]:
    """(top left, top right, bottom left) of plausible symbols, best first: like modules, equal legs at a right angle."""
    pool = sorted(patterns, key=lambda p: -p.count * p.module)[:MOST_PATTERNS]
    found = []
    for n, three in enumerate(combinations(pool, 3)):
        modules = [p.module for p in three]
        size = sum(modules) / 3
        spread = (max(modules) - min(modules)) / size
        if spread > SPREAD:
            continue
        across = [(b.x - a.x) ** 2 + (b.y - a.y) ** 2 for a, b in ((three[1], three[2]), (three[0], three[2]), (three[0], three[1]))]
        o = across.index(max(across))  # the corner lies opposite the longest side
        a, b = (p for k, p in enumerate(three) if k != o)
        u, v = (a.x - three[o].x, a.y - three[o].y), (b.x - three[o].x, b.y - three[o].y)
        legs, diagonal = (np.hypot(*u), np.hypot(*v)), across[o] ** 0.5
        leg = (legs[0] + legs[1]) / 2
        if not SPACING[0] <= leg / size <= SPACING[1] or abs(legs[0] - legs[1]) / leg > IMBALANCE:
            continue
        cosine = abs(u[0] * v[0] + u[1] * v[1]) / (legs[0] * legs[1])
        if cosine > COSINE:
            continue
        if u[0] * v[1] - u[1] * v[0] <= 0:
            a, b = b, a
        found.append((spread + abs(legs[0] - legs[1]) / leg + 2 * abs(diagonal - 2**0.5 * leg) / diagonal + cosine, n, (three[o], a, b)))
    return [t for _, _, t in sorted(found, key=lambda f: f[:2])]


def solved(rows: list[list[float]]) -> list[float] | None:
    """The solution of linear equations (coefficients, then the right side) by elimination with row exchange; None where a pivot vanishes."""
    m = np.array(rows, float)
    n = len(m)
    for k in range(n):
        best = k + int(np.abs(m[k:, k]).argmax())
        if abs(m[best, k]) < PIVOT:
            return None
        if best != k:
            m[[k, best]] = m[[best, k]]
        m[k, k:] /= m[k, k]
        m[k + 1 :, k:] -= m[k + 1 :, k : k + 1] * m[k, k:]
    x = m[:, n]
    for k in range(n - 1, 0, -1):
        x[:k] -= m[:k, k] * x[k]
    return x.tolist()


def homography(src: list[tuple[float, float]], dst: list[tuple[float, float]]) -> np.ndarray | None:
    """The 3x3 map that takes four points to four others; None if there is no single one."""
    rows = []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, u], [0, 0, 0, x, y, 1, -v * x, -v * y, v]]
    found = solved(rows)
    return None if found is None else np.array([*found, 1]).reshape(3, 3)


def apply(h: np.ndarray, x, y) -> tuple[np.ndarray, np.ndarray]:
    w = h[2, 0] * x + h[2, 1] * y + h[2, 2]
    return (h[0, 0] * x + h[0, 1] * y + h[0, 2]) / w, (h[1, 0] * x + h[1, 1] * y + h[1, 2]) / w


def sample(bits: np.ndarray, x, y, outside: bool | None = False) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pixels, and which points lie inside; beyond the frame `outside`, or the pixel at the edge for None."""
    i, j = np.floor(y).astype(int), np.floor(x).astype(int)
    h, w = bits.shape
    if i.size and i.min() >= 0 and j.min() >= 0 and i.max() < h and j.max() < w:
        return bits[i, j], np.ones(i.shape, bool)
    inside = (i >= 0) & (j >= 0) & (i < h) & (j < w)
    edge = bits[np.clip(i, 0, h - 1), np.clip(j, 0, w - 1)]
    return edge if outside is None else np.where(inside, edge, outside), inside


def reach(bits: np.ndarray, a: Pattern, b: Pattern) -> float | None:
    """Module size from one finder's centre towards another's, half way at most: its changes come after 1.5, 2.5 and 3.5 modules."""
    dx, dy = b.x - a.x, b.y - a.y
    size = np.hypot(dx, dy)
    if size == 0:
        return None
    t = np.arange(0.5, min(size / 2, sum(bits.shape)), 0.5)
    seen, inside = sample(bits, a.x + dx / size * t, a.y + dy / size * t)
    out = int(inside.argmin()) if not inside.all() else len(t)
    flips = t[:out][seen[:out] != np.concatenate([[True], seen[: out - 1]])[:out]][:3] - 0.25
    return float(flips[0] / 1.5 + flips[2] - flips[0]) / 3 if len(flips) == 3 else None


def module_between(bits: np.ndarray, a: Pattern, b: Pattern) -> float:
    both = [m for m in (reach(bits, a, b), reach(bits, b, a)) if m]
    return sum(both) / len(both) if both else (a.module + b.module) / 2


_I, _J = (g.ravel() for g in np.mgrid[-2:3, -2:3])
_RING = np.maximum(abs(_I), abs(_J)) != 1
_INNER = np.maximum(abs(_I), abs(_J)) < 2


def alignment_centre(bits: np.ndarray, x: float, y: float, u: np.ndarray, v: np.ndarray) -> tuple[float, float] | None:
    """The centre of the alignment pattern near a predicted point; u and v are a module's steps. Two modules around first, then five."""
    return _centre_within(bits, x, y, u, v, 2) or _centre_within(bits, x, y, u, v, 5)


def _centre_within(bits: np.ndarray, x: float, y: float, u: np.ndarray, v: np.ndarray, reach_: int) -> tuple[float, float] | None:
    step = max(0.5, min(np.hypot(*u), np.hypot(*v)) / 4)
    k = int(reach_ * max(np.hypot(*u), np.hypot(*v)) / step)
    side = np.arange(-k, k + 1) * step
    dx, dy = np.tile(side, len(side)), side.repeat(len(side))
    match = np.zeros(len(dx), int)
    for part in (_INNER, ~_INNER):  # three of 25 modules may differ, so what misses more of the inner nine is out
        i, j = _I[part], _J[part]
        seen, _ = sample(bits, (x + dx)[:, None] + (j * u[0] + i * v[0]), (y + dy)[:, None] + (j * u[1] + i * v[1]))
        match += (seen == _RING[part]).sum(1)
        least = match >= (6 if part is _INNER else 22)
        dx, dy, match = dx[least], dy[least], match[least]
        if not len(match):
            return None
    best = np.flatnonzero(match == match.max())
    near = best[np.argmin(dx[best] ** 2 + dy[best] ** 2)]
    own = best[np.hypot(dx[best] - dx[near], dy[best] - dy[near]) < 1.5 * max(np.hypot(*u), np.hypot(*v))]
    return x + float(dx[own].mean()), y + float(dy[own].mean())


@dataclass
class Detection:
    matrix: np.ndarray
    corners: list[tuple[float, float]]
    module: float
    patterns: tuple[Pattern, Pattern, Pattern]


def assemble(bits: np.ndarray, three: tuple[Pattern, Pattern, Pattern]) -> Iterator[Detection]:
    """Detections of a triple, by nearest version first, with an alignment pattern if one is found."""
    tl, tr, bl = three
    across, down = module_between(bits, tl, tr), module_between(bits, tl, bl)
    module = (across + down) / 2
    if module < 1:
        return
    guess = (np.hypot(tr.x - tl.x, tr.y - tl.y) / across + np.hypot(bl.x - tl.x, bl.y - tl.y) / down) / 2 + 7
    middle = int(np.floor((guess - 17) / 4 + 0.5))
    for version in (middle, middle - 1, middle + 1):
        if not 1 <= version <= 40 or abs(size_of(version) - guess) > SLACK:
            continue
        n = size_of(version)
        u = np.array([tr.x - tl.x, tr.y - tl.y]) / (n - 7)
        v = np.array([bl.x - tl.x, bl.y - tl.y]) / (n - 7)
        three_from, three_to = [(3.5, 3.5), (n - 3.5, 3.5), (3.5, n - 3.5)], [(tl.x, tl.y), (tr.x, tr.y), (bl.x, bl.y)]
        fourths = [((n - 3.5, n - 3.5), (tr.x + bl.x - tl.x, tr.y + bl.y - tl.y))]
        if version > 1:
            x, y = np.array([tl.x, tl.y]) + (u + v) * (n - 10)
            if (centre := alignment_centre(bits, x, y, u, v)) is not None:
                fourths.insert(0, ((n - 6.5, n - 6.5), centre))
        for src, dst in fourths:
            h = homography([*three_from, src], [*three_to, dst])
            if h is None:
                continue
            i = np.arange(8, n - 8)
            timing = np.concatenate([sample(bits, *apply(h, i + 0.5, np.full(len(i), 6.5)))[0], sample(bits, *apply(h, np.full(len(i), 6.5), i + 0.5))[0]])
            if (timing == np.tile(i % 2 == 0, 2)).mean() < TIMING:
                continue
            gy, gx = np.mgrid[:n, :n] + 0.5
            matrix, inside = sample(bits, *apply(h, gx, gy), outside=None)
            if (~inside).sum() > -(-n * n // 8) or version > 6 and read_version(matrix) not in (None, version):
                continue
            corners = [tuple(float(c) for c in apply(h, a, b)) for a, b in ((0, 0), (n, 0), (n, n), (0, n))]
            if np.isfinite(corners).all():
                yield Detection(matrix, corners, module, three)


def same_place(a: list[tuple[float, float]], b: list[tuple[float, float]]) -> bool:
    p, q = np.array(a), np.array(b)
    wide = max(np.hypot(*(c[0] - c[2])) for c in (p, q))
    return bool(np.hypot(*(p.mean(0) - q.mean(0))) < wide / 2)


def pass_scales(shape: tuple[int, int], try_harder: bool, max_downscale: float) -> list[int]:
    top, auto = max(1, int(max_downscale)), 1
    while auto * 2 <= top and max(shape) / auto > 1000:
        auto *= 2
    return [*([auto] if auto > 1 else []), 1, *([2] if try_harder and auto != 2 and min(shape) / 2 >= 21 else [])]


def scan(gray: np.ndarray, multiple: bool = False, try_harder: bool = False, try_inverted: bool = True, max_downscale: float = 1, max_candidates: int | None = None, locate_only: bool = False) -> tuple[list[dict], list[dict]]:
    """(results, detections) of a frame. Without `multiple` the first result ends the scan."""
    triples, most = (16, 8) if multiple else (4 if try_harder or locate_only else 1, 4)
    most = max_candidates or most
    results, detections = [], []
    for factor in pass_scales(gray.shape, try_harder, max_downscale):
        dark = binarize(gray if factor == 1 else downscale(gray, factor))
        for bits in (dark, ~dark) if try_inverted else (dark,):
            used: set[int] = set()
            for three in ranked_triples(finder_patterns(bits))[:triples]:
                if used & {id(p) for p in three}:
                    continue
                for found in assemble(bits, three):
                    corners = [(x * factor, y * factor) for x, y in found.corners]
                    if len(detections) < most and not any(same_place(d["corner_points"], corners) for d in detections):
                        detections.append({"corner_points": corners, "module_size": found.module * factor})
                    if locate_only:
                        break
                    try:
                        payload = decode(found.matrix)
                    except DecodeError:
                        continue
                    if not any(r["text"] == payload["text"] and same_place(r["corner_points"], corners) for r in results):
                        results.append(payload | {"corner_points": corners, "module_size": found.module * factor})
                    used |= {id(p) for p in three}
                    break
                if results and not multiple:
                    return results, detections
                if locate_only and len(detections) >= most:
                    return results, detections
    return results, detections
