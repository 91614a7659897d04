"""Symbols and frames made from texts: the other side of the codec, for carriers and tests."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tables import ALPHANUMERIC, FORMATS, LEVEL_BITS, VERSIONS, alignment, blocks, size_of
from .codec import COUNT_BITS, _schema, format_places, lengths, mask_of, order, remainders, version_places


def checks_of(data: np.ndarray, checks: int) -> np.ndarray:
    return remainders(np.concatenate([data, np.zeros(checks, np.int64)]).astype(np.uint8)[None], checks)[0].astype(np.int64)


def mode_of(text: str) -> int:
    return 1 if text.isascii() and text.isdigit() else 2 if all(c in ALPHANUMERIC for c in text) and text else 4


def payload_bits(text: str, version: int, append: tuple[int, int, int] | None = None) -> str:
    """Mode, count and characters as binary digits."""
    mode = mode_of(text)
    parts = [] if append is None else [{"mode": "append", "a": append[0], "b": append[1], "c": append[2]}]
    return "".join(segment_bits(p, version) for p in [*parts, {"mode": {1: "numeric", 2: "alphanumeric", 4: "byte"}[mode], "text": text}])


def fitted(text: str, level: str, append: tuple[int, int, int] | None = None) -> tuple[int, str]:
    """The least version that holds a text, and its payload there."""
    for band in (range(1, 10), range(10, 27), range(27, 41)):  # a payload is the same within one
        bits = payload_bits(text, band[0], append)
        for v in band:
            if len(bits) <= 8 * sum(blocks(v, level)[1]):
                return v, bits
    raise ValueError("the text doesn't fit a symbol")


def fitting_version(text: str, level: str, append: tuple[int, int, int] | None = None) -> int:
    return fitted(text, level, append)[0]


def segment_bits(segment: dict, version: int) -> str:
    """One segment as binary digits: mode, text, bytes and the numbers a, b and c of modes that have some.

    numeric, alphanumeric, byte (text or bytes), kanji; eci (a: assignment); append (a: index, b: total, c: parity);
    fnc1 and fnc1-second (a: indicator); raw (text: the digits themselves).
    """
    mode, text, a = segment["mode"], segment.get("text") or "", segment.get("a")
    band = (version > 9) + (version > 26)
    if mode == "raw":
        return text
    if mode == "eci":
        return "0111" + (f"{a:08b}" if a < 128 else f"10{a:014b}" if a < 1 << 14 else f"110{a:021b}")
    if mode == "append":
        return f"0011{a:04b}{segment['b'] - 1:04b}{segment['c']:08b}"
    if mode in ("fnc1", "fnc1-second"):
        return "0101" if mode == "fnc1" else f"1001{a:08b}"
    if mode == "kanji":
        raw = text.encode("cp932")
        pairs = [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw), 2)]
        pairs = [c - (0x8140 if c <= 0x9FFC else 0xC140) for c in pairs]
        return f"1000{len(pairs):0{COUNT_BITS[8][band]}b}" + "".join(f"{(c >> 8) * 0xC0 + (c & 255):013b}" for c in pairs)
    if mode == "byte":
        raw = segment.get("bytes")
        raw = text.encode() if raw is None else bytes(raw)
        return f"0100{len(raw):0{COUNT_BITS[4][band]}b}" + "".join(f"{b:08b}" for b in raw)
    return characters(text, 1 if mode == "numeric" else 2, version)


def characters(text: str, mode: int, version: int) -> str:
    """A numeric (1) or alphanumeric (2) segment."""
    out = [f"{mode:04b}", f"{len(text):0{COUNT_BITS[mode][(version > 9) + (version > 26)]}b}"]
    if mode == 1:
        out += [f"{int(text[i : i + 3]):0{(0, 4, 7, 10)[len(text[i : i + 3])]}b}" for i in range(0, len(text), 3)]
    else:
        at = [ALPHANUMERIC.index(c) for c in text]
        out += [f"{at[i] * 45 + at[i + 1]:011b}" if i + 1 < len(at) else f"{at[i]:06b}" for i in range(0, len(at), 2)]
    return "".join(out)


def encode(text: str, level: str = "M", version: int | None = None, mask: int = 2, append: tuple[int, int, int] | None = None) -> np.ndarray:
    """The matrix of a text, [row, column], dark is true."""
    version = version or fitting_version(text, level, append)
    return matrix_of(payload_bits(text, version, append), level, version, mask)


def codewords(bits: str, room: int) -> bytes:
    """A payload in binary digits as so many codewords, with its end and pads."""
    if len(bits) > 8 * room:
        raise ValueError("the payload doesn't fit the symbol")
    bits += "0" * min(4, 8 * room - len(bits))
    bits += "0" * (-len(bits) % 8)
    data = int(bits or "0", 2).to_bytes(len(bits) // 8, "big")
    return data + (b"\xec\x11" * room)[: room - len(data)]


@cache
def blank(version: int, level: str, mask: int) -> np.ndarray:
    """The matrix of a symbol whose codewords are all zero, of 0 and 1."""
    n = size_of(version)
    m = np.zeros((n, n), np.uint8)
    rows, cols = order(version)
    m[rows, cols] = mask_of(mask, n)[rows, cols]
    ring = np.maximum(*np.abs(np.mgrid[-3:4, -3:4]))
    for r, c in ((0, 0), (0, n - 7), (n - 7, 0)):
        m[r : r + 7, c : c + 7] = ring != 2
    m[6, 8 : n - 8] = m[8 : n - 8, 6] = np.arange(8, n - 8) % 2 == 0
    centres = alignment(version)
    for i, r in enumerate(centres):
        for j, c in enumerate(centres):
            if (i, j) not in {(0, 0), (0, len(centres) - 1), (len(centres) - 1, 0)}:
                m[r - 2 : r + 3, c - 2 : c + 3] = ring[1:6, 1:6] != 1
    code = FORMATS[LEVEL_BITS[level] << 3 | mask]
    for places in format_places(n):
        for k, p in enumerate(places):
            m[p] = code >> (14 - k) & 1
    m[n - 8, 8] = True
    if version > 6:
        for places in version_places(n):
            for k, p in enumerate(places):
                m[p] = VERSIONS[version] >> (17 - k) & 1
    return m


@cache
def sources(version: int) -> np.ndarray:
    """Of each module, row by row, the bit of the stream that it shows; one past the last for none."""
    n, (rows, cols) = size_of(version), order(version)
    bits = len(rows) // 8 * 8
    out = np.full(n * n, bits)
    out[rows[:bits] * n + cols[:bits]] = np.arange(bits)
    return out


def matrices_of(payloads: list[str], level: str, version: int, mask: int = 2) -> np.ndarray:
    """The matrices of payloads in binary digits, [symbol, row, column], of 0 and 1."""
    checks, sizes = blocks(version, level)
    count, room, n, at = len(payloads), sum(sizes), size_of(version), 0
    data = np.frombuffer(b"".join(codewords(p, room) for p in payloads), np.uint8).reshape(count, room)
    stream = np.zeros((count, room + checks * len(sizes) + 1), np.uint8)
    for k, places in lengths(version, level):
        words = np.zeros((count * len(places), k + checks), np.uint8)
        words[:, :k] = data[:, at : at + k * len(places)].reshape(-1, k)
        words[:, k:] = remainders(words, checks)
        stream[:, places.ravel()] = words.reshape(count, -1)
        at += k * len(places)
    return np.unpackbits(stream, axis=1).take(sources(version), 1).reshape(count, n, n) ^ blank(version, level, mask)


def matrix_of(bits: str, level: str, version: int, mask: int = 2) -> np.ndarray:
    """The matrix of a payload in binary digits, [row, column], dark is true."""
    return matrices_of([bits], level, version, mask)[0] != 0


def made_of(wanted: list[tuple[int, str] | None], level: str) -> list[np.ndarray | None]:
    """The matrix of each version and payload, those of a version made together."""
    out, of_version = [None] * len(wanted), defaultdict(list)
    for k, w in enumerate(wanted):
        if w is not None:
            of_version[w[0]].append(k)
    for version, own in of_version.items():
        for k, m in zip(own, matrices_of([wanted[k][1] for k in own], level, version), strict=True):
            out[k] = m
    return out


def spread(df: DataFrame) -> DataFrame:
    """df dealt out evenly over several tasks a core: a row is small in its file and much work here, and the splits of a small file are few."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def render(m: np.ndarray, scale: int = 6, margin: int = 4, dark: int = 0, light: int = 255) -> np.ndarray:
    """A gray frame of the matrix with a quiet zone."""
    out = np.pad(m, margin).repeat(scale, 0).repeat(scale, 1)
    return np.where(out, dark, light).astype(np.uint8)


def rgba(gray: np.ndarray) -> bytes:
    return np.dstack([gray, gray, gray, np.full_like(gray, 255)]).tobytes()


SEGMENTS = "array<struct<mode:string,text:string,bytes:binary,a:int,b:int,c:int>>"


def segment_symbols(df: DataFrame, segments: str, version: str, level: str = "M") -> DataFrame:
    """df with matrix and size of the symbol of a column of segments (SEGMENTS) at the version of another."""
    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string("matrix binary, size int").fields])
    arrow = _schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                made = made_of([(v, "".join(segment_bits(s, v) for s in parts)) for parts, v in zip(part.column(segments).to_pylist(), part.column(version).to_pylist(), strict=True)], level)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([m.tobytes() for m in made], pa.binary()), pa.array([len(m) for m in made], pa.int32())], schema=arrow)

    return spread(df).mapInArrow(work, schema)


def rendered(df: DataFrame, scale: int) -> DataFrame:
    """df with RGBA frames (data, width, height) of its matrix and size instead of these."""
    own = [f for f in df.schema.fields if f.name not in ("matrix", "size")]
    schema = T.StructType([*own, *T._parse_datatype_string("data binary, width int, height int").fields])
    arrow = _schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 50):
                part = batch.slice(i, 50)
                made = [render(np.frombuffer(m, np.uint8).reshape(n, n) != 0, scale) for m, n in zip(part.column("matrix").to_pylist(), part.column("size").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in own), pa.array([rgba(g) for g in made], pa.binary()), *(pa.array([g.shape[k] for g in made], pa.int32()) for k in (1, 0))], schema=arrow)

    return df.mapInArrow(work, schema)


def symbols(df: DataFrame, text: str, level: str = "M", render_scale: int | None = None) -> DataFrame:
    """df with matrix and size of the symbol of a text column; with a scale also an RGBA frame: data, width, height."""
    added = "matrix binary, size int" + (", data binary, width int, height int" if render_scale else "")
    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string(added).fields])
    arrow = _schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part, out = batch.slice(i, 200), [[] for _ in added.split(", ")]
                for m in made_of([None if t is None else fitted(t, level) for t in part.column(text).to_pylist()], level):
                    row = [None if m is None else m.tobytes(), None if m is None else len(m)]
                    if render_scale:
                        frame = None if m is None else render(m, render_scale)
                        row += [None] * 3 if frame is None else [rgba(frame), frame.shape[1], frame.shape[0]]
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                made = [pa.array(c, f.type) for c, f in zip(out, list(arrow)[len(part.columns) :], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], schema=arrow)

    return spread(df).mapInArrow(work, schema)


def side_by_side(df: DataFrame, left: str, right: str, level: str = "M", scale: int = 6, gap: int = 24) -> DataFrame:
    """df with an RGBA frame (data, width, height) that shows the symbols of two text columns."""
    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string("data binary, width int, height int").fields])
    arrow = _schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                part, frames = batch.slice(i, 100), []
                for two in zip(part.column(left).to_pylist(), part.column(right).to_pylist(), strict=True):
                    a, b = (render(encode(t, level), scale) for t in two)
                    frame = np.full((max(len(a), len(b)), a.shape[1] + gap + b.shape[1]), 255, np.uint8)
                    frame[: len(a), : a.shape[1]], frame[: len(b), -b.shape[1] :] = a, b
                    frames.append(frame)
                made = [pa.array([rgba(f) for f in frames], pa.binary()), *(pa.array([f.shape[k] for f in frames], pa.int32()) for k in (1, 0))]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], schema=arrow)

    return spread(df).mapInArrow(work, schema)


def damaged(matrix: Column, version: int, codewords: Column, most: int = 8) -> Column:
    """Matrices of this version with one module flipped in each of the first `codewords` codewords, `most` at most."""
    rows, cols = order(version)
    places = F.slice(F.array(*[F.lit(int(rows[8 * k] * size_of(version) + cols[8 * k]) + 1) for k in range(most)]), F.lit(1), codewords.cast("int"))
    light, dark = F.unhex(F.lit("00")), F.unhex(F.lit("01"))
    return F.aggregate(places, matrix, lambda m, at: F.overlay(m, F.when(F.substr(m, at, F.lit(1)) == dark, light).otherwise(dark), at, F.lit(1)))
