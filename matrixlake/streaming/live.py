"""The live scan: frames of a stream (or a table of them) to decodes, detections and errors.

frames: the key columns (what tells scanners apart), ts, data, width, height; order breaks ties of time. Frames that are
NULL, as a source gives when it isn't ready, use up nothing of the scan budget. The same calls take a table, with the
batch forms of each step. A stream writes its scanned frames once (writer), and detections, errors and sightings read them.

Options are those of the calls. To change them, stop the query and start it again with the new call and the same folder:
windows, rates and scan options aren't part of the state, so what was sighted stays known; only other keys or columns need
a fresh folder. To stop after the first decode, decodes(stop_on_decode=True) gives one row a scanner; its query may end then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import content
from ..functions.exprs import shifted
from ..operators import scan
from ..operators.codec import DECODED, POINT, SEGMENTS
from . import scanner

#: Parts of a result that travel as JSON through the state steps, which take flat columns.
_NESTED = {f.split(" ", 1)[0]: f.split(" ", 1)[1] for f in DECODED.split(", ") if f.split(" ", 1)[0] in ("structured_append", "fnc1")}
_NESTED |= {"corner_points": f"array<{POINT}>"}
_FLAT = ["text", "bytes", "version", "ec_level", "mask", "module_size"]
#: What a joined payload has of all of its parts: numbers that add up, and JSON lists.
_SUMS, _LISTS = ["ecc_blocks", "ecc_corrected"], ["_segments"]


def scan_live(frames: DataFrame, keys: list[str], per_second: float = 15, ts: str = "ts", order: list[str] = (), **options) -> DataFrame:
    """Throttled frames with results, detections and error_code, as scan_frames() gives them."""
    take = scanner.throttle_stream if frames.isStreaming else scanner.throttle
    return scan.scan_frames(take(frames.filter("data is not null"), keys, per_second, ts, list(order)), **options)


def in_frame(scanned: DataFrame, x: Column, y: Column) -> DataFrame:
    """Corner points of a crop moved by its origin, into the whole frame."""
    move = lambda rows: F.transform(rows, lambda r: r.withField("corner_points", shifted(r["corner_points"], x, y)))
    return scanned.withColumns({c: move(F.col(c)) for c in ("results", "detections")})


def sightings(scanned: DataFrame, keys: list[str], reassemble: bool = False, ttl_ms: int = scanner.TTL_MS, ts: str = "ts", order: list[str] = ()) -> DataFrame:
    """A row for each result in order (symbol_seq), payloads split over symbols joined if asked for."""
    order = [*order, "symbol_seq"]
    rows, header = scan.results_of(scanned, parse_content=False), F.col("structured_append")
    rows = rows.select(*dict.fromkeys([*keys, ts, *order]), *_FLAT, F.to_json(F.struct(*_NESTED)).alias("_nested"), F.col("ecc.blocks").alias("ecc_blocks"), F.col("ecc.codewords_corrected").alias("ecc_corrected"), F.coalesce(F.to_json("segments"), F.lit("[]")).alias("_segments"), *[header[c].alias(c) for c in ("index", "total", "parity")])
    if reassemble:
        join = scanner.reassemble_stream if rows.isStreaming else scanner.reassemble
        rows = join(rows, keys, ts, ttl_ms, order, last=["version", "ec_level", "mask", "module_size", "_nested"], sums=_SUMS, lists=_LISTS)
    return rows.drop("index", "total", "parity")


def decodes(seen: DataFrame, keys: list[str], window_ms: int = scanner.WINDOW_MS, parse_content: bool = True, ts: str = "ts", order: list[str] = (), stop_on_decode: bool = False) -> DataFrame:
    """What a scanner emits of its sightings: each text once until its window has passed without a sighting.

    With stop_on_decode only the first: a scanner stops with it.

    A streaming query holds one state step of this kind: with reassemble, sightings of a stream are written and read first.
    """
    order = [*order, "symbol_seq"]
    if stop_on_decode:
        rows = (scanner.first_stream if seen.isStreaming else scanner.first)(seen, keys, ts, order)
    elif seen.isStreaming:
        rows = scanner.deduplicate_stream(seen, [*keys, "text"], ts, window_ms, order)
    else:
        rows = scanner.deduplicate(seen, [*keys, "text"], ts, window_ms, order).filter("emit").drop("emit")
    back = F.from_json("_nested", "struct<" + ",".join(f"{k}:{t}" for k, t in _NESTED.items()) + ">")
    ecc = F.struct(F.col("ecc_blocks").alias("blocks"), F.col("ecc_corrected").alias("codewords_corrected"))
    out = rows.withColumn("_n", back).select(*dict.fromkeys([*keys, ts, *order]), *_FLAT, F.from_json("_segments", SEGMENTS).alias("segments"), ecc.alias("ecc"), "_n.*")
    return out.withColumn("content", content.parse_content(F.col("text"), F.coalesce(F.col("fnc1.position") == "first", F.lit(False)))) if parse_content else out


def detections(scanned: DataFrame) -> DataFrame:
    """One row for each scanned frame; NULL where nothing was located."""
    return scanned.drop("results", "error_code")


def errors(scanned: DataFrame) -> DataFrame:
    return scanned.filter("error_code is not null").drop("results", "detections")


def writer(rows: DataFrame, folder: str, name: str) -> DataStreamWriter:
    """A writer of a stream to `folder`/`name`, to be started; the checkpoint lies beside it, and a fresh folder is a fresh scanner."""
    return rows.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-checkpoint")
