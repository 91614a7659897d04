"""Frames from files and tables, and results from other detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import clamped_region


def image_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames of image files: source, width, height and RGBA data. Spark decodes to BGR or BGRA; channels are put in order here."""
    i = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def reorder(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            out = []
            for raw, n, w, h in zip(*(b.column(c).to_pylist() for c in ("data", "nChannels", "width", "height")), strict=True):
                p = np.frombuffer(raw, np.uint8).reshape(h, w, n)
                rgb = np.repeat(p, 3, 2) if n == 1 else p[..., 2::-1]
                out.append(np.dstack([rgb, p[..., 3:] if n == 4 else np.full((h, w, 1), 255, np.uint8)]).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("origin"), b.column("width"), b.column("height"), pa.array(out, pa.binary())], names=["source", "width", "height", "data"])

    return i.mapInArrow(reorder, "source string, width int, height int, data binary")


def raw_frames(spark: SparkSession, path: str, width: int, height: int, stream: bool = False) -> DataFrame:
    """Frames of files that hold RGBA pixels of one size: source, ts (when the file was written), width, height and data."""
    reader = spark.readStream.schema("path string, modificationTime timestamp, length bigint, content binary") if stream else spark.read
    files = reader.format("binaryFile").load(path)
    return files.select(F.col("path").alias("source"), F.col("modificationTime").alias("ts"), F.lit(width).alias("width"), F.lit(height).alias("height"), F.col("content").alias("data"))


def cropped(df: DataFrame, x: Column, y: Column, width: Column, height: Column) -> DataFrame:
    """df with its frames cut to a rectangle, which is held within each frame; `origin` is where that begins.

    NULL and short buffers stay as they are, for the scan to report. Scan, then move the points back by live.in_frame().
    """
    area = clamped_region(x, y, width, height, F.col("width"), F.col("height"))
    fits = F.length("data") >= F.col("width").cast("bigint") * F.col("height") * 4
    marked = df.withColumn("origin", F.when(fits, area))
    kind = marked.schema

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            out = []
            for raw, w, h, r in zip(*(b.column(c) for c in ("data", "width", "height", "origin")), strict=True):
                raw, w, h, r = raw.as_py(), w.as_py(), h.as_py(), r.as_py()
                if r is None:
                    out.append((raw, w, h))
                    continue
                part = np.frombuffer(raw, np.uint8, 4 * w * h).reshape(h, w, 4)[r["y"] : r["y"] + r["height"], r["x"] : r["x"] + r["width"]]
                out.append((part.tobytes(), r["width"], r["height"]))
            new = dict(zip(("data", "width", "height"), zip(*out, strict=True), strict=True)) if out else {}
            yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else b.column(f.name) for f in b.schema], schema=b.schema)

    return marked.mapInArrow(cut, kind)


def valid_frames(df: DataFrame) -> DataFrame:
    """Frames whose buffer holds all their pixels."""
    return df.filter(F.length("data") >= F.col("width").cast("bigint") * F.col("height") * 4)


def external_results(df: DataFrame, limit: int | None = 1) -> DataFrame:
    """Another detector's findings (frame_id, seq, text, corner_points) as results with placeholder metadata; four corners needed."""
    side = lambda a, b: F.hypot(F.col("corner_points")[a]["x"] - F.col("corner_points")[b]["x"], F.col("corner_points")[a]["y"] - F.col("corner_points")[b]["y"])
    good = df.filter(F.size("corner_points") == 4)
    good = good.filter(F.col("seq") < limit) if limit else good
    return good.select("*", F.encode("text", "UTF-8").alias("bytes"), ((side(0, 1) + side(0, 3)) / 2 / 25).alias("module_size"), F.lit(0).alias("version"), F.lit("M").alias("ec_level"), F.lit(-1).alias("mask"), F.struct(F.lit(0).alias("blocks"), F.lit(0).alias("codewords_corrected")).alias("ecc"))
