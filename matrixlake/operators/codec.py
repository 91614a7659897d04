"""From a module matrix to its payload: format, codewords, error correction, segments. One numpy kernel a task."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.exprs import LOGS, POWERS
from ..functions.tables import ALPHANUMERIC, CHARSETS, FORMATS, LEVEL_BITS, VERSIONS, WIDE_CHARSETS, alignment, blocks, size_of

EXP = np.array(POWERS * 2, np.int64)
LOG = np.array([0, *(LOGS[i] for i in range(1, 256))], np.int64)
COUNT_BITS = {1: (10, 12, 14), 2: (9, 11, 13), 4: (8, 16, 16), 8: (8, 10, 12)}
MODES = {1: "numeric", 2: "alphanumeric", 4: "byte", 7: "eci", 8: "kanji"}

POINT = "struct<x:double,y:double>"
SEGMENTS = "array<struct<mode:string,text:string,bytes:binary,assignment:int>>"
DECODED = (
    f"text string, bytes binary, version int, ec_level string, mask int, segments {SEGMENTS}, ecc struct<blocks:int,codewords_corrected:int>, "
    "structured_append struct<index:int,total:int,parity:int>, fnc1 struct<position:string,application_indicator:string>"
)


class DecodeError(Exception):
    """What a symbol fails by; `code` is what the error column holds."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(message or code)
        self.code = code


@cache
def reserved(version: int) -> np.ndarray:
    """True where a module belongs to a function pattern, [row, column]."""
    n = size_of(version)
    out = np.zeros((n, n), bool)
    out[:9, :9] = out[:9, -8:] = out[-8:, :9] = True
    out[6, :] = out[:, 6] = True
    centres = alignment(version)
    corners = {(0, 0), (0, len(centres) - 1), (len(centres) - 1, 0)}
    for i, r in enumerate(centres):
        for j, c in enumerate(centres):
            if (i, j) not in corners:
                out[r - 2 : r + 3, c - 2 : c + 3] = True
    if version > 6:
        out[:6, n - 11 : n - 8] = out[n - 11 : n - 8, :6] = True
    return out


@cache
def order(version: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the data modules in reading order: pairs of columns from the right, up and down in turn."""
    n, taken, rows, cols = size_of(version), reserved(version), [], []
    right, up = n - 1, True
    while right > 0:
        right -= right == 6
        for y in range(n - 1, -1, -1) if up else range(n):
            for x in (right, right - 1):
                if not taken[y, x]:
                    rows.append(y)
                    cols.append(x)
        right, up = right - 2, not up
    return np.array(rows), np.array(cols)


@cache
def mask_of(mask: int, n: int) -> np.ndarray:
    y, x = np.mgrid[:n, :n]
    p = y * x
    return [(y + x) % 2, y % 2, x % 3, (y + x) % 3, (y // 2 + x // 3) % 2, p % 2 + p % 3, (p % 2 + p % 3) % 2, ((y + x) % 2 + p % 3) % 2][mask] == 0


@cache
def layout(version: int, level: str) -> list[np.ndarray]:
    """For each block the places of its codewords in the interleaved stream, data first."""
    checks, data = blocks(version, level)
    at, out = 0, [[] for _ in data]
    for i in range(max(data)):
        for b, k in enumerate(data):
            if i < k:
                out[b].append(at)
                at += 1
    for _ in range(checks):
        for b in range(len(data)):
            out[b].append(at)
            at += 1
    return [np.array(x) for x in out]


def bits_at(m: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> int:
    """The number that modules spell, most significant bit first."""
    return int.from_bytes(np.packbits(m[rows, cols]).tobytes(), "big") >> -len(rows) % 8


def format_places(n: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(row, column) of both copies of the format information, most significant bit first."""
    one = [(8, c) for c in range(6)] + [(8, 7), (8, 8), (7, 8)] + [(r, 8) for r in range(5, -1, -1)]
    two = [(n - 1 - i, 8) for i in range(7)] + [(8, n - 8 + i) for i in range(8)]
    return one, two


def version_places(n: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    places = [(i // 3, n - 11 + i % 3) for i in range(17, -1, -1)]
    return places, [(c, r) for r, c in places]


@cache
def places_of(kind: str, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of both copies of the format or version information."""
    copies = format_places(n) if kind == "format" else version_places(n)
    return [tuple(np.array(x) for x in zip(*places, strict=True)) for places in copies]


def read_nearest(readings: list[int], table: list[tuple[int, int]]) -> int | None:
    best = min(((min((r ^ c).bit_count() for r in readings), sum((r ^ c).bit_count() for r in readings), i, d) for i, (d, c) in enumerate(table)))
    return best[3] if best[0] <= 3 else None


def read_format(m: np.ndarray) -> tuple[str, int]:
    data = read_nearest([bits_at(m, *p) for p in places_of("format", len(m))], list(enumerate(FORMATS)))
    if data is None:
        raise DecodeError("format-info")
    return next(k for k, b in LEVEL_BITS.items() if b == data >> 3), data & 7


def read_version(m: np.ndarray) -> int | None:
    """The version that a symbol of 7 or more declares; None if it can't be read."""
    return read_nearest([bits_at(m, *p) for p in places_of("version", len(m))], list(VERSIONS.items()))


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where((a == 0) | (b == 0), 0, EXP[LOG[a] + LOG[b]])


#: Products of all pairs of field elements.
PRODUCT = multiply(np.arange(256)[:, None], np.arange(256)).astype(np.uint8)
INVERSE = np.concatenate([[0], EXP[255 - LOG[1:]]])
#: Modules that are held at once where symbols are worked on together.
MODULES = 1 << 22


@cache
def generator(checks: int) -> tuple[int, ...]:
    """Product of (x - a^i), highest power first."""
    out = [1]
    for i in range(checks):
        grown = [*out, 0]
        for k, c in enumerate(out):
            if c:
                grown[k + 1] ^= int(EXP[LOG[c] + i])
        out = grown
    return tuple(out)


@cache
def multiples(checks: int) -> np.ndarray:
    """Of each field element, a row, its products with the generator's coefficients after the first."""
    return np.ascontiguousarray(PRODUCT[:, generator(checks)[1:]])


def remainders(words: np.ndarray, checks: int) -> np.ndarray:
    """What is left of blocks of one length (a row each, highest power first) divided by the generator: nothing of sound ones."""
    rest, table = words.copy(), multiples(checks)
    for k in range(words.shape[1] - checks):
        rest[:, k + 1 : k + 1 + checks] ^= table[rest[:, k]]
    return rest[:, -checks:]


@cache
def exponents(n: int, checks: int) -> np.ndarray:
    """Of each root, a row, the exponents that it has at the places of a block."""
    return np.arange(checks)[:, None] * np.arange(n - 1, -1, -1) % 255


def correct(word: np.ndarray, checks: int) -> int:
    """Corrects a block in place (highest power first); returns how many codewords it changed."""
    n = len(word)
    powers = np.arange(n - 1, -1, -1)
    some = np.flatnonzero(word)
    syndromes = np.bitwise_xor.reduce(EXP[exponents(n, checks)[:, some] + LOG[word[some]]], 1).tolist()
    if not any(syndromes):
        return 0
    gf = lambda a, b: int(EXP[LOG[a] + LOG[b]]) if a and b else 0
    locator, old, length, shift, last = [1], [1], 0, 1, 1
    for k, s in enumerate(syndromes):
        gap = s
        for i in range(1, min(length, len(locator) - 1) + 1):
            gap ^= gf(locator[i], syndromes[k - i])
        if not gap:
            shift += 1
            continue
        scale = gf(gap, int(EXP[255 - LOG[last]]))
        moved = [0] * shift + [gf(scale, c) for c in old]
        fresh = [a ^ b for a, b in zip(locator + [0] * (len(moved) - len(locator)), moved + [0] * (len(locator) - len(moved)), strict=True)]
        if 2 * length <= k:
            old, length, last, shift = locator, k + 1 - length, gap, 1
        else:
            shift += 1
        locator = fresh
    while locator[-1] == 0:
        locator.pop()
    errors = len(locator) - 1
    if 2 * errors > checks or errors != length:
        raise DecodeError("reed-solomon")
    value = np.zeros(n, np.int64)
    for i, c in enumerate(locator):  # the locator at the inverse of each place
        if c:
            value ^= EXP[(LOG[c] + i * (255 - powers)) % 255]
    places = np.flatnonzero(value == 0)
    if len(places) != errors:
        raise DecodeError("reed-solomon")
    omega = [0] * checks
    for i, a in enumerate(locator):
        for j in range(checks - i):
            omega[i + j] ^= gf(a, syndromes[j])
    for p in places.tolist():
        x = int(powers[p])
        inverse = (255 - x) % 255
        top = slope = 0
        for i, c in enumerate(omega):
            top ^= gf(c, int(EXP[inverse * i % 255]))
        for i in range(1, len(locator), 2):
            slope ^= gf(locator[i], int(EXP[inverse * (i - 1) % 255]))
        if not slope:
            raise DecodeError("reed-solomon")
        word[p] ^= gf(gf(top, int(EXP[255 - LOG[slope]])), int(EXP[x % 255]))
    return errors


def correct_all(words: np.ndarray, checks: int) -> np.ndarray:
    """`correct` for blocks of one length, a row each: how many codewords it changed in each, -1 for what can't be corrected."""
    rest, out = remainders(words, checks), np.zeros(len(words), np.int64)
    bad = np.flatnonzero(rest.any(1))
    if not len(bad):
        return out
    powers = np.arange(words.shape[1] - 1, -1, -1)
    syndromes = np.zeros((len(bad), checks), np.uint8)
    for i, e in enumerate(exponents(checks, checks).T):
        syndromes ^= PRODUCT[rest[bad, i, None], EXP[e]]
    locator = np.zeros((len(bad), checks + 1), np.uint8)
    locator[:, 0] = 1
    old, length, last = locator, np.zeros(len(bad), np.int64), np.ones(len(bad), np.uint8)
    for k in range(checks):
        gap = np.bitwise_xor.reduce(PRODUCT[locator[:, : k + 1], syndromes[:, k::-1]], 1)
        old = np.concatenate([np.zeros_like(old[:, :1]), old[:, :-1]], 1)
        fresh = locator ^ PRODUCT[PRODUCT[gap, INVERSE[last]][:, None], old]
        grows = (gap != 0) & (2 * length <= k)
        old, last, length = np.where(grows[:, None], locator, old), np.where(grows, gap, last), np.where(grows, k + 1 - length, length)
        locator = fresh
    errors = checks - (locator[:, ::-1] != 0).argmax(1)
    good = np.flatnonzero((2 * errors <= checks) & (errors == length))
    most = int(errors[good].max(initial=0))
    value = np.zeros((len(good), len(powers)), np.uint8)
    for i in range(most + 1):
        value ^= PRODUCT[locator[good, i, None], EXP[i * (255 - powers) % 255]]
    found = (value == 0).sum(1) == errors[good]
    good, value = good[found], value[found]
    out[bad] = -1
    out[bad[good]] = errors[good]
    omega = np.zeros((len(good), most), np.uint8)
    for i in range(most):
        omega[:, i:] ^= PRODUCT[locator[good, i, None], syndromes[good, : most - i]]
    row, place = np.nonzero(value == 0)  # each root is there once, so the slope isn't zero
    top, slope = np.zeros((2, len(row)), np.uint8)
    for i in range(most):
        at = EXP[(255 - powers[place]) * i % 255]
        top ^= PRODUCT[omega[row, i], at]
        if i % 2 == 0:
            slope ^= PRODUCT[locator[good[row], i + 1], at]
    words[bad[good[row]], place] ^= PRODUCT[PRODUCT[top, INVERSE[slope]], EXP[powers[place] % 255]]
    return out


class Bits:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def read(self, n: int) -> int:
        if n > self.left:
            raise DecodeError("bitstream", "the data end within a segment")
        self.left -= n
        return self.value >> self.left & ((1 << n) - 1)


@cache
def letters(codec: str) -> list[str]:
    """The characters of a one-byte set. Bytes 0x80 to 0x9F that a Windows set leaves open are control characters."""
    out = [bytes([b]).decode(codec, "replace") for b in range(256)]
    return [chr(b) if c == "\ufffd" and codec.startswith("cp") and 0x80 <= b < 0xA0 else c for b, c in enumerate(out)]


def byte_text(raw: bytes, assignment: int | None) -> str:
    """By the named character set; else strict UTF-8; else Western European (windows-1252). A byte order mark goes."""
    codec = CHARSETS.get(assignment)
    if codec is None:
        try:
            return raw.decode("utf-8").removeprefix("\ufeff")
        except UnicodeDecodeError:
            codec = "cp1252"
    if codec in WIDE_CHARSETS:
        text = raw.decode(codec, "replace")
        return text.removeprefix("\ufeff") if codec.startswith("utf") else text
    return "".join(map(letters(codec).__getitem__, raw))


@dataclass
class Stream:
    text: str = ""
    bytes: bytes = b""
    segments: list[dict] = field(default_factory=list)
    structured_append: dict | None = None
    fnc1: dict | None = None


def escapes(text: str) -> str:
    return text.replace("%%", "\0").replace("%", "\x1d").replace("\0", "%")


def read_segments(data: bytes, version: int) -> Stream:
    bits, out, assignment = Bits(data), Stream(), None
    band = (version > 9) + (version > 26)
    while bits.left >= 4 and (mode := bits.read(4)):
        text, raw = None, None
        if mode in COUNT_BITS:
            count = bits.read(COUNT_BITS[mode][band])
        if mode == 1:
            text = ""
            for k in [3] * (count // 3) + [count % 3] * (count % 3 > 0):
                value = bits.read((0, 4, 7, 10)[k])
                if value >= 10**k:
                    raise DecodeError("bitstream", "a group of digits is out of range")
                text += f"{value:0{k}d}"
        elif mode == 2:
            text = ""
            for k in [2] * (count // 2) + [1] * (count % 2):
                value = bits.read(11 if k == 2 else 6)
                if value >= 45**k:
                    raise DecodeError("bitstream", "a pair of characters is out of range")
                text += (ALPHANUMERIC[value // 45] if k == 2 else "") + ALPHANUMERIC[value % 45]
            text = escapes(text) if out.fnc1 else text
        elif mode == 4:
            raw = bits.read(8 * count).to_bytes(count, "big")
            text = byte_text(raw, assignment)
        elif mode == 8:
            raw = b""
            for _ in range(count):
                value = bits.read(13)
                pair = (value // 0xC0 << 8) + value % 0xC0
                raw += (pair + (0x8140 if pair + 0x8140 <= 0x9FFC else 0xC140)).to_bytes(2, "big")
            text = raw.decode("cp932", "replace")
        elif mode == 7:
            lead = bits.read(8)
            assignment = lead if lead < 0x80 else (lead & 0x3F) << 8 | bits.read(8) if lead < 0xC0 else (lead & 0x1F) << 16 | bits.read(16) if lead < 0xE0 else None
            if assignment is None:
                raise DecodeError("bitstream", "a character set can't be read")
            out.segments.append({"mode": "eci", "assignment": assignment})
            continue
        elif mode == 3:
            out.structured_append = {"index": bits.read(4), "total": bits.read(4) + 1, "parity": bits.read(8)}
            continue
        elif mode == 5:
            out.fnc1 = {"position": "first", "application_indicator": None}
            continue
        elif mode == 9:
            value = bits.read(8)
            out.fnc1 = {"position": "second", "application_indicator": chr(value - 100) if 100 <= value <= 226 else f"{value:02d}"}
            continue
        else:
            raise DecodeError("bitstream", f"there is no mode {mode}")
        raw = text.encode() if raw is None else raw
        out.text += text
        out.bytes += raw
        out.segments.append({"mode": MODES[mode], "text": text, "bytes": raw})
    return out


def decode(m: np.ndarray) -> dict:
    """The payload of a square matrix of modules, [row, column], dark is true."""
    n = len(m)
    if m.shape != (n, n) or not 21 <= n <= 177 or n % 4 != 1:
        raise DecodeError("invalid-dimension", "no symbol has this size")
    version = (n - 17) // 4
    level, mask = read_format(m)
    rows, cols = order(version)
    stream = np.packbits((m ^ mask_of(mask, n))[rows, cols][: len(rows) // 8 * 8]).astype(np.int64)
    checks, _ = blocks(version, level)
    data, corrected = b"", 0
    for places in layout(version, level):
        word = stream[places]
        corrected += correct(word, checks)
        data += word[:-checks].astype(np.uint8).tobytes()
    return payload(data, version, level, mask, corrected)


def payload(data: bytes, version: int, level: str, mask: int, corrected: int) -> dict:
    found = read_segments(data, version)
    return {"text": found.text, "bytes": found.bytes, "version": version, "ec_level": level, "mask": mask, "segments": found.segments, "ecc": {"blocks": len(layout(version, level)), "codewords_corrected": corrected}, "structured_append": found.structured_append, "fnc1": found.fnc1}


@cache
def lengths(version: int, level: str) -> list[tuple[int, np.ndarray]]:
    """Data codewords and `layout` of the blocks of each length, a row a block, in the order of the data."""
    checks, _ = blocks(version, level)
    places = layout(version, level)
    return [(n - checks, np.array([p for p in places if len(p) == n])) for n in sorted({len(p) for p in places})]


def decode_all(m: np.ndarray) -> list[dict]:
    """`decode` for matrices of one proper size, [symbol, row, column]; those that fail have only an error_code."""
    n = m.shape[1]
    version, out = (n - 17) // 4, [{"error_code": "format-info"} for _ in m]
    spelled = np.stack([m[:, *p] @ (1 << np.arange(14, -1, -1)) for p in places_of("format", n)], 1)
    off = np.bitwise_count(spelled[:, :, None] ^ np.array(FORMATS)).astype(np.int64)
    least = off.min(1)
    nearest = (32 * least + off.sum(1)).argmin(1)
    nearest[least[np.arange(len(m)), nearest] > 3] = -1
    rows, cols = order(version)
    whole = len(rows) // 8 * 8
    for data in set(nearest.tolist()) - {-1}:
        level, mask = next(k for k, b in LEVEL_BITS.items() if b == data >> 3), data & 7
        own = np.flatnonzero(nearest == data)
        stream = np.packbits(m.reshape(len(m), -1)[own].take(rows[:whole] * n + cols[:whole], 1) ^ mask_of(mask, n)[rows, cols][:whole], 1)
        checks, _ = blocks(version, level)
        parts, corrected = [], []
        for k, places in lengths(version, level):
            words = stream.take(places.ravel(), 1).reshape(-1, places.shape[1])
            corrected.append(correct_all(words, checks).reshape(len(own), -1))
            parts.append(words[:, :k].reshape(len(own), -1))
        read, changed = np.concatenate(parts, 1), np.concatenate(corrected, 1)
        for i, codewords, sound, count in zip(own.tolist(), read, (changed >= 0).all(1).tolist(), changed.sum(1).tolist(), strict=True):
            try:
                out[i] = payload(codewords.tobytes(), version, level, mask, count) if sound else {"error_code": "reed-solomon"}
            except DecodeError as e:
                out[i] = {"error_code": e.code}
    return out


def _schema(spark_schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark_schema)


def decode_matrices(df: DataFrame, matrix: str = "matrix", size: str = "size") -> DataFrame:
    """df with the payload of each matrix (bytes, row by row, nonzero is dark), or why it has none in error_code.

    The decoded columns are NULL where error_code isn't; a NULL matrix is `invalid-dimension`.
    """
    from pyspark.sql import functions as F

    added = T._parse_datatype_string(DECODED + ", error_code string")
    schema = T.StructType([*df.schema.fields, *added.fields])
    arrow, extra = _schema(schema), _schema(added)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part, of_size = batch.slice(i, 1000), defaultdict(list)
                rows = [{"error_code": "invalid-dimension"}] * part.num_rows
                raws = part.column(matrix).to_pylist()
                for k, (raw, n) in enumerate(zip(raws, part.column(size).to_pylist(), strict=True)):
                    if raw is not None and n is not None and 21 <= n <= 177 and n % 4 == 1 and len(raw) == n * n:
                        of_size[n].append(k)
                for n, own in of_size.items():
                    for at in range(0, len(own), MODULES // n**2):
                        some = own[at : at + MODULES // n**2]
                        m = np.frombuffer(b"".join(raws[k] for k in some), np.uint8).reshape(-1, n, n) != 0
                        for k, row in zip(some, decode_all(m), strict=True):
                            rows[k] = row
                made = pa.RecordBatch.from_pylist(rows, schema=extra)
                yield pa.RecordBatch.from_arrays([*part.columns, *made.columns], schema=arrow)

    return df.select("*").mapInArrow(work, schema) if df.columns else df.select(F.lit(None))
