import datetime

import numpy as np
from pyspark.sql import functions as F

from matrixlake.operators import encode, scan
from matrixlake.sources import frames as sources
from matrixlake.streaming import live

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def shown(*rows):
    """Rows of a frame table: scanner, milliseconds, symbol (or None)."""
    out = []
    for source, ms, m in rows:
        g = None if m is None else encode.render(m, 4)
        out.append((source, START + datetime.timedelta(milliseconds=ms), None if m is None else bytearray(encode.rgba(g)), 0 if m is None else g.shape[1], 0 if m is None else g.shape[0]))
    return out


def table(spark):
    whole = "left and right"
    parity = 0
    for b in whole.encode():
        parity ^= b
    first, second = (encode.encode(t, "M", append=(i, 2, parity)) for i, t in enumerate((whole[:5], whole[5:])))
    tel = encode.encode("tel:12", "M")
    rows = shown(("a", 0, tel), ("a", 50, tel), ("a", 200, None), ("a", 1000, tel), ("a", 2600, tel), ("b", 0, first), ("b", 500, second), ("b", 5000, tel))
    rows.append(("c", START, bytearray(9), 50, 50))
    return spark.createDataFrame(rows, "source string, ts timestamp, data binary, width int, height int")


WANT = [("a", 0, "tel:12", "tel"), ("a", 2600, "tel:12", "tel"), ("b", 500, "left and right", "text"), ("b", 5000, "tel:12", "tel")]


def emitted(df):
    return sorted((r.source, int((r.ts.replace(tzinfo=datetime.timezone.utc) - START).total_seconds() * 1000), r.text, r.kind) for r in df.select("source", "ts", "text", F.col("content.type").alias("kind")).collect())


def test_live_scan_of_a_table(spark):
    scanned = live.scan_live(table(spark), ["source"], per_second=10).cache()
    out = live.decodes(live.sightings(scanned, ["source"], reassemble=True), ["source"])
    assert emitted(out) == WANT
    assert out.filter("size(corner_points) = 4 and ecc.blocks = 1").count() == 3
    joined = out.filter("text = 'left and right'").collect()[0]
    assert (joined.ecc.blocks, [(s.mode, s.text, bytes(s.bytes)) for s in joined.segments]) == (2, [("byte", "left ", b"left "), ("byte", "and right", b"and right")])
    stopped = live.decodes(live.sightings(scanned, ["source"], reassemble=True), ["source"], stop_on_decode=True)
    assert emitted(stopped) == [WANT[0], WANT[2]]
    assert [r.error_code for r in live.errors(scanned).collect()] == ["frame"]
    assert live.detections(scanned).filter("detections is null").count() == 1
    moved = live.in_frame(scanned, F.lit(100.0), F.lit(0.0)).filter("source = 'a'").select(F.col("results")[0]["corner_points"][0]["x"].alias("x")).first().x
    assert moved > 100


def test_live_scan_of_a_stream(spark, tmp_path):
    table(spark).write.parquet(str(tmp_path / "frames"))

    def through(rows, name):
        live.writer(rows, str(tmp_path), name).trigger(availableNow=True).start().awaitTermination(120)
        path = str(tmp_path / name)
        return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)

    frames = spark.readStream.schema(table(spark).schema).parquet(str(tmp_path / "frames"))
    scanned = through(live.scan_live(frames, ["source"], per_second=10), "scanned")
    through(live.errors(scanned), "errors")
    seen = through(live.sightings(scanned, ["source"], reassemble=True), "sightings")
    through(live.decodes(seen, ["source"]), "decodes")
    assert emitted(spark.read.parquet(str(tmp_path / "decodes"))) == WANT
    assert spark.read.parquet(str(tmp_path / "decodes")).filter("text = 'left and right' and ecc.blocks = 2 and size(segments) = 2").count() == 1
    assert spark.read.parquet(str(tmp_path / "errors")).count() == 1


def test_crops_and_raw_files(spark, tmp_path):
    one = encode.render(encode.encode("inside", "M"), 4)
    wide = np.full((one.shape[0] + 40, one.shape[1] + 300), 255, np.uint8)
    wide[30 : 30 + one.shape[0], 250 : 250 + one.shape[1]] = one
    (tmp_path / "f0.rgba").write_bytes(encode.rgba(wide))
    (tmp_path / "f1.rgba").write_bytes(b"short")
    h, w = wide.shape
    df = sources.raw_frames(spark, str(tmp_path), w, h)
    part = sources.cropped(df, F.lit(240.7), F.lit(-5), F.lit(9999), F.lit(h + 50))
    scanned = live.in_frame(scan.scan_frames(part), F.col("origin.x"), F.col("origin.y")).orderBy("source").collect()
    assert [(r.origin and tuple(r.origin), r.error_code) for r in scanned] == [((240, 0, w - 240, h), None), (None, "frame")]
    whole = {r.text: r.corner_points for r in scan.decode_frames(df).collect()}
    (got,) = scanned[0].results
    assert got.text == "inside"
    assert all(abs(a.x - b.x) < 1 and abs(a.y - b.y) < 1 for a, b in zip(got.corner_points, whole["inside"], strict=True))
    stream = sources.raw_frames(spark, str(tmp_path), w, h, stream=True)
    assert stream.isStreaming
    assert stream.schema == df.schema
