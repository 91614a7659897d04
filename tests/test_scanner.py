import json
import os
import random
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from matrixlake.functions.content import parse_content
from matrixlake.streaming import scanner


def at(df):
    return df.withColumn("ts", F.timestamp_millis(F.col("ms") + 1_700_000_000_000))


def folded(rows, window):
    last, out = {}, []
    for key, ms, n in sorted(rows, key=lambda r: (r[1], r[2])):
        out.append((n, key not in last or ms - last[key] >= window))
        last[key] = ms
    return sorted(out)


def test_deduplicate(spark):
    rng, rows = random.Random(2), []
    for k in range(20):
        ms = 0
        for _ in range(30):
            ms += rng.choice([1, 500, 1499, 1500, 1501])
            rows.append((f"k{k}", ms, len(rows)))
    df = at(spark.createDataFrame(rows, "key string, ms bigint, n int"))
    got = sorted((r.n, r.emit) for r in scanner.deduplicate(df, ["key"], order=["n"]).collect())
    assert got == folded(rows, 1500)
    assert all(r.emit for r in scanner.deduplicate(df, ["key"], window_ms=0).collect())


def test_deduplicate_across_spans(spark):
    rng = np.random.default_rng(3)
    rows = [(k, int(t)) for k in "ab" for t in np.cumsum(rng.choice([0, 1, 9, 10, 11, 170], 400))]
    want, last = [], {}
    for i, (k, t) in enumerate(rows):
        want.append((i, k not in last or t - last[k] >= 10))
        last[k] = t
    df = at(spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "i int, key string, ms bigint"))
    got = scanner.deduplicate(df, ["key"], window_ms=10, order=["i"])
    assert sorted((r.i, r.emit) for r in got.collect()) == want
    none = df.limit(2).withColumn("ts", F.lit(None).cast("timestamp"))
    assert [r.emit for r in scanner.deduplicate(none, ["key"]).collect()] == [True, True]


def test_throttle(spark):
    rows = [("a", t) for t in (0, 50, 100, 101, 199, 200, 350)] + [("b", 30)]
    df = at(spark.createDataFrame(rows, "key string, ms bigint"))
    got = sorted((r.key, r.ms) for r in scanner.throttle(df, ["key"], 10).collect())
    assert got == [("a", 0), ("a", 100), ("a", 200), ("a", 350), ("b", 30)]


PARTS = [(0, 0, 2, "ab"), (10, 1, 2, "cd"), (20, 1, 2, "cd"), (30, 5, 2, "no"), (40, 0, 1, "no"), (40_000, 0, 2, "ab"), (70_000, 1, 2, "cd"), (100_001, 0, 2, "ab")]
PARITY = ord("a") ^ ord("b") ^ ord("c") ^ ord("d")


def part_rows(spark):
    rows = [("s", ms, i, t, PARITY, text, bytearray(text.encode())) for ms, i, t, text in PARTS] + [("w", 1, 0, 2, 1, "ab", bytearray(b"ab")), ("w", 2, 1, 2, 1, "cd", bytearray(b"cd"))]
    return at(spark.createDataFrame(rows, "source string, ms bigint, index int, total int, parity int, text string, bytes binary"))


def test_reassemble(spark):
    got = sorted((r.ms, r.text, bytes(r.bytes)) for r in scanner.reassemble(part_rows(spark), ["source"]).collect())
    assert got == [(10, "abcd", b"abcd"), (20, "abcd", b"abcd"), (70_000, "abcd", b"abcd")]


def test_joined_parts_add_up(spark, tmp_path):
    rows = [{"source": k, "ms": 10 * i, "index": i, "total": 3, "parity": ord("a") ^ ord("b") ^ ord("c"), "text": "abc"[i], "n": i + 1, "list": ["[1]", "[]", "[2,3]"][i], "mine": i} for i in (2, 0, 1) for k in ("s", None)]
    schema = "source string, ms bigint, index int, total int, parity int, text string, n int, list string, mine int"
    make = lambda s, f: f(at(s).withColumn("bytes", F.col("text").cast("binary")), ["source"], sums=["n"], lists=["list"], last=["mine"])
    want = [("abc", 6, "[1,2,3]", 2, 20)] * 2
    got = make(spark.createDataFrame([tuple(r.values()) for r in rows], schema), scanner.reassemble).collect()
    assert [(r.text, r.n, r.list, r.mine, r.ms) for r in got] == want
    got = streamed(spark, tmp_path, schema, [rows], lambda s: make(s, scanner.reassemble_stream))
    assert [(r.text, r.n, r.list, r.mine, r.ms) for r in got] == want


def test_state_shrinks_and_clocks_do_not_go_back(spark, tmp_path):
    """Keys that come no more lose their state; a late row in time counts, but the last sighting stays the last."""
    days = [[{"key": f"k{d}-{i}", "ms": d * 86_400_000 + i} for i in range(50)] for d in range(4)]
    days[3] += [{"key": "x", "ms": 3 * 86_400_000 + 9_000}]
    days += [[{"key": "x", "ms": 3 * 86_400_000 + 8_000}], [{"key": "x", "ms": 3 * 86_400_000 + 10_000}], [{"key": "x", "ms": 3 * 86_400_000 + 10_600}]]
    sizes = []

    def make(s):
        return scanner.deduplicate_stream(at(s), ["key"])

    class Watch(StreamingQueryListener):
        def onQueryStarted(self, event):  # noqa: N802
            pass

        def onQueryProgress(self, event):  # noqa: N802
            sizes.extend(o.numRowsTotal for o in event.progress.stateOperators)

        def onQueryIdle(self, event):  # noqa: N802
            pass

        def onQueryTerminated(self, event):  # noqa: N802
            pass

    watch = Watch()
    spark.streams.addListener(watch)
    try:
        got = streamed(spark, tmp_path, "key string, ms bigint", days, make)
        time.sleep(1)
    finally:
        spark.streams.removeListener(watch)
    assert max(sizes) <= 110 and sum(map(len, days)) > 200
    assert sorted(r.ms - 3 * 86_400_000 for r in got if r.key == "x") == [9_000]


def test_first_rows(spark, tmp_path):
    rows = [{"key": k, "ms": t} for t in (5, 7, 9) for k in "ab"]
    got = streamed(spark, tmp_path, "key string, ms bigint", [rows[:2], rows[2:]], lambda s: scanner.first_stream(at(s), ["key"]))
    assert sorted((r.key, r.ms) for r in got) == [("a", 5), ("b", 5)]
    got = scanner.first(at(spark.createDataFrame(pd.DataFrame(rows))), ["key"]).collect()
    assert sorted((r.key, r.ms) for r in got) == [("a", 5), ("b", 5)]


def streamed(spark, tmp_path, schema, chunks, make):
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(chunks):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(tmp_path / "in" / f"{i}.json", (1e9 + i, 1e9 + i))  # files are read in this order
    out: list = []
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = make(source).writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return out


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [{"key": "a", "ms": t} for t in (0, 500, 1999, 3499, 3500)] + [{"key": "b", "ms": 10}]
    (tmp_path / "d").mkdir()
    got = streamed(spark, tmp_path / "d", "key string, ms bigint", [rows[:2], rows[2:]], lambda s: scanner.deduplicate_stream(at(s), ["key"]))
    batch = scanner.deduplicate(at(spark.createDataFrame(pd.DataFrame(rows))), ["key"]).filter("emit").collect()
    assert sorted((r.key, r.ms) for r in got) == sorted((r.key, r.ms) for r in batch) == [("a", 0), ("a", 3499), ("b", 10)]
    parts = [{"source": "s", "ms": ms, "index": i, "total": t, "parity": PARITY, "text": text} for ms, i, t, text in PARTS]
    (tmp_path / "r").mkdir()
    make = lambda s: scanner.reassemble_stream(at(s).withColumn("bytes", F.col("text").cast("binary")), ["source"])
    got = streamed(spark, tmp_path / "r", "source string, ms bigint, index int, total int, parity int, text string", [parts[:1], parts[1:5], parts[5:]], make)
    assert sorted((r.ms, r.text) for r in got) == [(10, "abcd"), (20, "abcd"), (70_000, "abcd")]


def test_throttle_stream(spark, tmp_path):
    rows = [{"key": "a", "ms": t} for t in (0, 50, 100, 101, 199, 200, 350)] + [{"key": "b", "ms": 30}]
    got = streamed(spark, tmp_path, "key string, ms bigint", [rows[:2], rows[2:5], rows[5:]], lambda s: scanner.throttle_stream(at(s), ["key"], 10))
    assert sorted((r.key, r.ms) for r in got) == [("a", 0), ("a", 100), ("a", 200), ("a", 350), ("b", 30)]


CASES = [
    ("WIFI:T:WPA;S:my\\;net;P:a\\:b;H:true;;", {"type": "wifi", "ssid": "my;net", "password": "a:b", "security": "WPA", "hidden": True}),
    ("WIFI:S:x;T:nopass;P:zz;;", {"type": "wifi", "ssid": "x", "security": "nopass"}),
    ("WIFI:T:WPA;P:x;;", {"type": "text", "text": "WIFI:T:WPA;P:x;;"}),
    ("geo:1.5,-2,3", {"type": "geo", "latitude": 1.5, "longitude": -2.0, "altitude": 3.0}),
    ("TEL:+1 2", {"type": "tel", "number": "+1 2"}),
    ("tel:1\n", {"type": "text", "text": "tel:1\n"}),
    ("smsto:12:hi: there", {"type": "sms", "number": "12", "message": "hi: there"}),
    ("sms:5?body=a%20b+c", {"type": "sms", "number": "5", "message": "a b+c"}),
    ("sms:5?body=%FF", {"type": "sms", "number": "5", "message": "%FF"}),
    ("mailto:a%40b?subject=x+y&body=1", {"type": "email", "email_to": "a@b", "subject": "x y", "body": "1"}),
    ("MATMSG:TO:a;SUB:b;;", {"type": "email", "email_to": "a", "subject": "b"}),
    ("MATMSG:SUB:b;;", {"type": "text", "text": "MATMSG:SUB:b;;"}),
    (" BEGIN:VCARD\nFN: Jo \r\nTEL;HOME:12\nEND", {"type": "vcard", "raw": " BEGIN:VCARD\nFN: Jo \r\nTEL;HOME:12\nEND", "name": "Jo", "tel": "12"}),
    ("https://example.com/a b", {"type": "url", "url": "https://example.com/a b"}),
    ("http://", {"type": "text", "text": "http://"}),
    ("", {"type": "text", "text": ""}),
]


def test_content(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    for r in df.select("i", parse_content(F.col("t")).alias("c")).collect():
        assert {k: v for k, v in r.c.asDict().items() if v is not None} == CASES[r.i][1]
    gs = {"0112345678901234\x1d10ABC\x1d17260101": [("01", "12345678901234"), ("10", "ABC"), ("17", "260101")], "3103000123": [("3103", "000123")], "41012": None, "\x1d21XY": [("21", "XY")], "10": None, "ab": None}
    out = spark.createDataFrame([(t,) for t in gs], "t string").select("t", parse_content(F.col("t"), True)["elements"].alias("e")).collect()
    assert {r.t: r.e and [tuple(x) for x in r.e] for r in out} == gs
