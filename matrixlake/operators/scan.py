"""Frames to results: the scan kernel as DataFrame operators, one Arrow crossing for each batch of frames.

A frame is a row with data (RGBA bytes), width and height; other columns are carried along. NULL frames, and buffers
that are too short, give no result and an error_code instead of a failed task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import content
from .codec import DECODED, POINT, DecodeError, _schema
from .vision import gray_of, scan

RESULT = f"struct<{', '.join(c.replace(' ', ':', 1) for c in DECODED.split(', '))},corner_points:array<{POINT}>,module_size:double>".replace(", ", ",")
DETECTION = f"struct<corner_points:array<{POINT}>,module_size:double>"


def scan_frames(df: DataFrame, **options) -> DataFrame:
    """One row a frame: the other columns of df with results, detections (NULL when there are none) and error_code.

    Options: multiple, try_harder, try_inverted, max_downscale, max_candidates, locate_only.
    """
    carried = [f for f in df.schema.fields if f.name != "data"]
    added = T._parse_datatype_string(f"results array<{RESULT}>, detections array<{DETECTION}>, error_code string")
    schema = T.StructType([*carried, *added.fields])
    arrow, extra = _schema(schema), _schema(added)

    def point(p: tuple[float, float]) -> dict:
        return {"x": p[0], "y": p[1]}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, width, height in zip(*(batch.column(c) for c in ("data", "width", "height")), strict=True):
                try:
                    if not data.is_valid or not width.is_valid or not height.is_valid:
                        raise DecodeError("frame", "there is no frame")
                    results, detections = scan(gray_of(data.as_py(), width.as_py(), height.as_py()), **options)
                    for r in [*results, *detections]:
                        r["corner_points"] = [point(p) for p in r["corner_points"]]
                    rows.append({"results": results, "detections": detections or None})
                except DecodeError as e:
                    rows.append({"results": [], "error_code": e.code})
                except Exception:  # a frame must not fail the stream
                    rows.append({"results": [], "error_code": "runner-failed"})
            made = pa.RecordBatch.from_pylist(rows, schema=extra)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in carried), *made.columns], schema=arrow)

    return df.mapInArrow(work, schema)


def results_of(scanned: DataFrame, parse_content: bool = True) -> DataFrame:
    """A row for each result, in order (symbol_seq from 0), with its content if asked for."""
    own = [c for c in scanned.columns if c not in ("results", "detections", "error_code")]
    out = scanned.select(*own, F.posexplode("results").alias("symbol_seq", "r")).select(*own, "symbol_seq", "r.*")
    return out.withColumn("content", content.parse_content(F.col("text"), F.coalesce(F.col("fnc1.position") == "first", F.lit(False)))) if parse_content else out


def decode_frames(df: DataFrame, parse_content: bool = True, **options) -> DataFrame:
    """The first symbol of each frame; frames without one have no row."""
    return results_of(scan_frames(df, **options), parse_content).filter("symbol_seq = 0")


def decode_all_frames(df: DataFrame, parse_content: bool = True, **options) -> DataFrame:
    return results_of(scan_frames(df, multiple=True, **options), parse_content)


def detect_frames(df: DataFrame, max_candidates: int = 4, **options) -> DataFrame:
    """A row for each symbol that is located, decoded or not."""
    scanned = scan_frames(df, locate_only=True, max_candidates=max_candidates, **options)
    own = [c for c in scanned.columns if c not in ("results", "detections", "error_code")]
    return scanned.select(*own, F.posexplode("detections").alias("symbol_seq", "d")).select(*own, "symbol_seq", "d.*")
