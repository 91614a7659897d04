"""Scalar rules of the codec as column expressions: field arithmetic, check bits, masks, geometry."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import FIELD, FORMAT_GENERATOR, FORMAT_MASK, VERSION_GENERATOR


def _powers() -> list[int]:
    out, x = [], 1
    for _ in range(255):
        out.append(x)
        x = x << 1 ^ (FIELD if x & 0x80 else 0)
    return out


POWERS = _powers()
LOGS = {x: i for i, x in enumerate(POWERS)}


def _literal(values: list[int]) -> Column:
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<int>)")


def alpha_pow(e: Column) -> Column:
    return F.element_at(_literal(POWERS), (F.pmod(e, F.lit(255)) + 1).cast("int"))


def gf_log(a: Column) -> Column:
    """NULL for 0, which has no logarithm."""
    return F.when((a > 0) & (a < 256), F.element_at(_literal([LOGS[i] for i in range(1, 256)]), F.greatest(a, F.lit(1)).cast("int")))


def gf_mul(a: Column, b: Column) -> Column:
    return F.when((a == 0) | (b == 0), 0).otherwise(alpha_pow(gf_log(a) + gf_log(b)))


def gf_inv(a: Column) -> Column:
    return alpha_pow(255 - gf_log(a))


def gf_div(a: Column, b: Column) -> Column:
    """NULL for division by 0."""
    return F.when(b == 0, None).when(a == 0, 0).otherwise(alpha_pow(gf_log(a) - gf_log(b)))


def poly_eval(coefficients: Column, x: Column) -> Column:
    """Value at x of a polynomial with ascending coefficients, by Horner's rule."""
    return F.aggregate(F.reverse(coefficients), F.lit(0), lambda acc, c: gf_mul(acc, x).bitwiseXOR(c))


def bch(value: Column, generator: int, bits: int) -> Column:
    """value * x^degree plus its remainder; bits: how many value has."""
    degree = generator.bit_length() - 1
    out = F.shiftleft(value, degree)
    for k in reversed(range(bits)):  # clears bit k + degree if it is set
        out = out.bitwiseXOR(F.shiftright(out, k + degree).bitwiseAND(1) * (generator << k))
    return F.shiftleft(value, degree).bitwiseOR(out)


def format_codeword(data: Column) -> Column:
    return F.aggregate(F.array(data.cast("int")), F.lit(0), lambda _, d: bch(d, FORMAT_GENERATOR, 5)).bitwiseXOR(F.lit(FORMAT_MASK))


def version_codeword(version: Column) -> Column:
    return F.aggregate(F.array(version.cast("int")), F.lit(0), lambda _, d: bch(d, VERSION_GENERATOR, 6))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _readings(table: tuple[tuple[int, int], ...], most: int) -> bytes:
    """For each reading a byte: four times the data of its nearest entry plus the distance; 255 beyond `most` flips."""
    codes = np.array([c for _, c in table])
    all_ = np.arange(1 << int(codes.max()).bit_length())
    best, out = np.full(len(all_), 99), np.full(len(all_), 255, np.uint8)
    for d, c in table:
        apart = np.bitwise_count(all_ ^ c)
        near = apart < np.minimum(best, most + 1)
        best[near], out[near] = apart[near], 4 * d + apart[near]
    return out.tobytes()


def nearest(bits: Column, table: list[tuple[int, int]], second: Column | None = None, most: int = 3) -> Column:
    """struct(data, distance) of the entry nearest to a reading, or to the better of two; NULL beyond `most` flips.

    Ties go to the smaller sum of both distances, then to the first entry. One reading is looked up in a table of all
    readings (up to 2^18 bytes in the plan); NULL if it has more bits than they.
    """
    if second is None and most < 4 and max(d for d, _ in table) < 63 and max(c for _, c in table) < 1 << 18:
        raw = _readings(tuple(table), most)
        found = F.conv(F.hex(F.substring(F.lit(raw), bits.cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        found = F.when((bits >= 0) & (bits < len(raw)), F.nullif(found, F.lit(255)))
        return F.element_at(F.transform(F.array(found), lambda v: F.when(v.isNotNull(), F.struct(F.shiftright(v, 2).alias("data"), v.bitwiseAND(3).alias("distance")))), 1)
    second = bits if second is None else second
    rows = F.array(*[F.struct(F.least(hamming(bits, F.lit(c)), hamming(second, F.lit(c))).cast("int").alias("distance"), (hamming(bits, F.lit(c)) + hamming(second, F.lit(c))).cast("int").alias("both"), F.lit(i).alias("place"), F.lit(d).alias("data")) for i, (d, c) in enumerate(table)])
    best = F.array_min(rows)
    return F.when(best["distance"] <= most, F.struct(best["data"].alias("data"), best["distance"].alias("distance")))


def mask_bit(mask: Column, row: Column, col: Column) -> Column:
    """Whether the mask flips the module; NULL for an unknown mask."""
    p = row * col
    rules = [(row + col) % 2 == 0, row % 2 == 0, col % 3 == 0, (row + col) % 3 == 0, (F.floor(row / 2) + F.floor(col / 3)) % 2 == 0, p % 2 + p % 3 == 0, (p % 2 + p % 3) % 2 == 0, ((row + col) % 2 + p % 3) % 2 == 0]
    out = F.when(mask == 0, rules[0])
    for k, rule in enumerate(rules[1:], 1):
        out = out.when(mask == k, rule)
    return out


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(77 * r + 150 * g + 29 * b, 8)


def version_for_size(size: Column) -> Column:
    return F.when(size.between(21, 177) & ((size - 17) % 4 == 0), ((size - 17) / 4).cast("int"))


def homography_point(h: Column, x: Column, y: Column) -> Column:
    """struct(x, y): the point under a row-major 3x3 map."""
    at = lambda k: F.element_at(h, k)
    w = at(7) * x + at(8) * y + at(9)
    return F.struct(((at(1) * x + at(2) * y + at(3)) / w).alias("x"), ((at(4) * x + at(5) * y + at(6)) / w).alias("y"))


def finder_score(runs: list[Column]) -> Column:
    """Deviation of five runs from 1:1:3:1:1 as a share of their sum; NULL if it isn't a finder profile."""
    total = runs[0] + runs[1] + runs[2] + runs[3] + runs[4]
    off = sum((F.abs(r - total * w / 7.0) for r, w in zip(runs, (1, 1, 3, 1, 1), strict=True)), F.lit(0.0)) / total
    return F.when((total >= 7) & (off <= 0.25), off)


def scaled(corners: Column, factor: Column | float) -> Column:
    return F.transform(corners, lambda p: F.struct((p["x"] * factor).alias("x"), (p["y"] * factor).alias("y")))


def shifted(corners: Column, dx: Column, dy: Column) -> Column:
    return F.transform(corners, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def clamped_region(x: Column, y: Column, width: Column, height: Column, w: Column, h: Column) -> Column:
    """A crop rectangle floored and held within a frame, at least one pixel each way."""
    left, top = (F.greatest(F.lit(0), F.least(F.floor(a), b - 1)) for a, b in ((x, w), (y, h)))
    return F.struct(left.cast("int").alias("x"), top.cast("int").alias("y"), F.greatest(F.lit(1), F.least(F.floor(width), w - left)).cast("int").alias("width"), F.greatest(F.lit(1), F.least(F.floor(height), h - top)).cast("int").alias("height"))


def scales(width: Column, height: Column, try_harder: bool = False, max_downscale: float = 1) -> Column:
    """Pass factors: a coarse one for large frames, the frame itself, and half size for a harder try."""
    top, longest, auto = max(1, int(max_downscale)), F.greatest(width, height), F.lit(1)
    k = 1
    while 2 * k <= top:
        auto = F.when((auto == k) & (longest / k > 1000), 2 * k).otherwise(auto)
        k *= 2
    half = F.lit(try_harder) & (auto != 2) & (F.least(width, height) / 2 >= 21)
    return F.concat(F.when(auto > 1, F.array(auto)).otherwise(F.array().cast("array<int>")), F.array(F.lit(1)), F.when(half, F.array(F.lit(2))).otherwise(F.array().cast("array<int>")))


def element_points(points: Column, fit: Column, video: tuple[Column, Column], element: tuple[Column, Column]) -> Column:
    """Points of a video shown in an element by object-fit, which centres it; a size of 0 leaves them as they are.

    fill stretches each way; contain and cover keep the ratio and show all of it, or leave no gap; none keeps the size;
    scale-down is the smaller of none and contain.
    """
    (vw, vh), (ew, eh) = video, element
    across, down = ew / vw, eh / vh
    inside = F.least(across, down)
    even = F.when(fit == "cover", F.greatest(across, down)).when(fit == "none", 1.0).when(fit == "scale-down", F.least(F.lit(1.0), inside)).otherwise(inside)
    sx, sy = F.when(fit == "fill", across).otherwise(even), F.when(fit == "fill", down).otherwise(even)
    moved = F.transform(points, lambda p: F.struct((p["x"] * sx + (ew - vw * sx) / 2).alias("x"), (p["y"] * sy + (eh - vh * sy) / 2).alias("y")))
    return F.when((vw > 0) & (vh > 0) & (ew > 0) & (eh > 0), moved).otherwise(points)
