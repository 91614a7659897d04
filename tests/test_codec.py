import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matrixlake.functions import exprs, tables
from matrixlake.operators import codec, encode, scan, scenes


def bits(*parts):
    joined = "".join(f"{v:0{n}b}" for v, n in parts)
    joined += "0" * (-len(joined) % 8)
    return bytes(int(joined[i : i + 8], 2) for i in range(0, len(joined), 8))


def test_known_codewords():
    assert tables.FORMATS[0b01100] == 0b110011000101111
    assert tables.VERSIONS[7] == 0b000111110010010100
    assert min((a ^ b).bit_count() for a in tables.FORMATS for b in tables.FORMATS if a != b) >= 7
    assert exprs.POWERS[7] == 0x80
    assert exprs.POWERS[8] == 0x1D


def test_blocks_fill_the_symbol():
    for v in range(1, 41):
        assert len(codec.order(v)[0]) == tables.data_modules(v)
        for level in tables.LEVELS:
            checks, data = tables.blocks(v, level)
            assert sum(data) + checks * len(data) == tables.data_modules(v) // 8


def test_round_trips_of_every_version_level_and_mask():
    rng = random.Random(3)
    for v in range(1, 41):
        for level in tables.LEVELS:
            text = "".join(rng.choice("abc XYZ019é") for _ in range(min(200, sum(tables.blocks(v, level)[1]) // 2 - 2)))
            for mask in range(8):
                got = codec.decode(encode.encode(text, level, v, mask))
                assert (got["text"], got["version"], got["ec_level"], got["mask"]) == (text, v, level, mask)


def test_segments():
    numeric = codec.read_segments(bits((1, 4), (8, 10), (12, 10), (345, 10), (67, 7), (0, 4)), 1)
    assert numeric.text == "01234567"
    assert codec.read_segments(bits((2, 4), (5, 9), (462, 11), (1849, 11), (2, 6), (0, 4)), 1).text == "AC-42"
    assert codec.read_segments(bits((4, 4), (2, 8), (0xE9, 8), (0x21, 8), (0, 4)), 1).text == "é!"
    assert codec.read_segments(bits((8, 4), (2, 8), (3487, 13), (6826, 13), (0, 4)), 1).text == "点茗"
    eci = codec.read_segments(bits((7, 4), (9, 8), (4, 4), (1, 8), (0xE1, 8), (4, 4), (1, 8), (0xE2, 8), (0, 4)), 1)
    assert (eci.text, [s["mode"] for s in eci.segments]) == ("αβ", ["eci", "byte", "byte"])
    fnc = codec.read_segments(bits((5, 4), (2, 4), (4, 9), (38 * 45 + 38, 11), (10 * 45 + 38, 11), (0, 4)), 1)
    assert (fnc.text, fnc.fnc1["position"]) == ("%A\x1d", "first")
    joined = codec.read_segments(bits((3, 4), (1, 4), (2, 4), (77, 8), (4, 4), (1, 8), (65, 8), (0, 4)), 1)
    assert joined.structured_append == {"index": 1, "total": 3, "parity": 77}


@pytest.mark.parametrize("raw", [bits((1, 4), (8, 10), (12, 10)), bits((2, 4), (5, 9)), bits((4, 4), (9, 8), (1, 8)), bits((8, 4), (4, 8), (1, 8)), bits((7, 4))])
def test_truncated_data_are_an_error(raw):
    with pytest.raises(codec.DecodeError) as e:
        codec.read_segments(raw, 1)
    assert e.value.code == "bitstream"


def test_error_correction():
    rng = np.random.default_rng(1)
    for checks in (7, 10, 16, 17, 24, 30):
        for errors in range(checks // 2 + 1):
            word = rng.integers(0, 256, 40)
            word = np.concatenate([word, encode.checks_of(word, checks)])
            bad = word.copy()
            bad[rng.choice(len(word), errors, replace=False)] ^= rng.integers(1, 256, errors)
            assert codec.correct(bad, checks) == errors
            assert (bad == word).all()


def test_decode_matrices_reports_failures(spark):
    good = encode.encode("HELLO", "M").astype(np.uint8).tobytes()
    rows = [(1, bytearray(good), 21), (2, bytearray(good), 25), (3, None, 21), (4, bytearray(b"\1" * 441), 21)]
    got = {r.id: r for r in codec.decode_matrices(spark.createDataFrame(rows, "id int, matrix binary, size int")).collect()}
    assert (got[1].text, got[1].error_code) == ("HELLO", None)
    assert got[2].error_code == got[3].error_code == "invalid-dimension"
    assert got[4].error_code


def test_expressions(spark):
    p = spark.range(256 * 256).select((F.col("id") % 256).cast("int").alias("a"), F.expr("cast(id div 256 as int)").alias("b"))
    out = p.select("a", "b", exprs.gf_mul(F.col("a"), F.col("b")).alias("m"), exprs.gf_div(F.col("a"), F.col("b")).alias("d"), exprs.gf_mul(exprs.gf_div(F.col("a"), F.col("b")), F.col("b")).alias("back")).toPandas()
    assert (out.m == codec.multiply(out.a.values, out.b.values)).all()
    assert (out.back[out.b > 0] == out.a[out.b > 0]).all()
    assert out.d[out.b == 0].isna().all()
    codes = spark.range(32).select(exprs.format_codeword(F.col("id"))).toPandas().iloc[:, 0].tolist()
    assert codes == tables.FORMATS
    versions = spark.range(7, 41).select(exprs.version_codeword(F.col("id"))).toPandas().iloc[:, 0].tolist()
    assert versions == list(tables.VERSIONS.values())
    got = spark.createDataFrame([(640, 480, 1), (3000, 2000, 4), (30, 30, 1)], "w int, h int, m int").select(exprs.scales(F.col("w"), F.col("h"), True, 4).alias("s")).collect()
    assert [r.s for r in got] == [[1, 2], [2, 1], [1]] or [r.s for r in got] == [[1, 2], [4, 1, 2], [1]]


def test_matrices_read_together_are_read_as_one_by_one():
    rng = np.random.default_rng(2)

    def alone(m):
        try:
            return codec.decode(m)
        except codec.DecodeError as e:
            return {"error_code": e.code}

    seen = set()
    for version, level, mask in ((1, "L", 0), (2, "M", 2), (5, "Q", 5), (7, "H", 7), (12, "M", 1), (28, "M", 2)):
        room = 8 * sum(tables.blocks(version, level)[1])
        payloads = ["", "0110", "1" * room, *(encode.payload_bits(t, version) for t in ("", "0123456789", "A-1", "é b") * 4)]
        made = encode.matrices_of(payloads, level, version, mask) != 0
        assert all((m == encode.matrix_of(p, level, version, mask)).all() for m, p in zip(made, payloads, strict=True))
        for m, flips in zip(made, np.resize([0, 1, 3, 6, 12, 200], len(made)), strict=True):
            m.reshape(-1)[rng.integers(0, m.size, flips)] ^= True
        got = codec.decode_all(made)
        assert got == [alone(m) for m in made]
        seen |= {g.get("error_code") or g["ecc"]["codewords_corrected"] > 0 for g in got}
    assert seen >= {True, False, "bitstream", "reed-solomon"}


@pytest.mark.parametrize("checks", [7, 10, 17, 30])
def test_blocks_corrected_together_are_corrected_as_one_by_one(checks):
    rng = np.random.default_rng(checks)
    for n in (checks + 1, 44, 153):
        words = rng.integers(0, 256, (3 * checks, n))
        for errors, w in enumerate(words[: checks + 1]):
            w[-checks:] = encode.checks_of(w[:-checks], checks)
            w[rng.choice(n, errors, replace=False)] ^= rng.integers(1, 256, errors)
        together = words.astype(np.uint8)
        for count, w, t in zip(codec.correct_all(together, checks).tolist(), words, together, strict=True):
            try:
                assert codec.correct(w, checks) == count
                assert (w == t).all()
            except codec.DecodeError:
                assert count == -1


def test_a_matrix_of_negative_size_is_an_error(spark):
    rows = spark.createDataFrame([(bytearray(441), -21)], "matrix binary, size int")
    assert codec.decode_matrices(rows).first().error_code == "invalid-dimension"


def tasks_of(df):
    """How many tasks make the rows of df."""
    return df.select(F.spark_partition_id().alias("task")).distinct().count()


def test_symbols_of_segments_in_one_split_are_made_by_many_tasks(spark):
    part = "named_struct('mode', 'byte', 'text', concat('row ', id), 'bytes', cast(null as binary), 'a', 0, 'b', 0, 'c', 0)"
    rows = spark.range(1200).coalesce(1).select("id", F.expr(f"array({part})").alias("parts"), (F.col("id") % 12 + 1).cast("int").alias("v"))
    made = codec.decode_matrices(encode.segment_symbols(rows, "parts", "v"))
    assert tasks_of(made) >= 8
    got = sorted((r.id, r.text, r.version, r.size, r.error_code) for r in made.collect())
    assert got == [(i, f"row {i}", i % 12 + 1, 4 * (i % 12 + 1) + 17, None) for i in range(1200)]


def test_frames_of_one_split_are_made_by_many_tasks(spark):
    rows = spark.range(64).coalesce(1).select("id", F.concat(F.lit("row "), "id").alias("text"), F.lit("clean").alias("scene"))
    for made in (scenes.frames(rows, "text", "scene", "id"), encode.side_by_side(rows, "text", "scene")):
        assert tasks_of(made) >= 8
        got = scan.decode_all_frames(made.select("id", "data", "width", "height"), parse_content=False)
        assert {r.text for r in got.filter("text != 'clean'").collect()} == {f"row {i}" for i in range(64)}


def test_symbols_of_one_split_are_made_by_many_tasks(spark):
    text = F.when(F.col("id") % 7 > 0, F.repeat(F.concat(F.lit("row "), "id"), F.col("id").cast("int") % 40))
    made = codec.decode_matrices(encode.symbols(spark.range(600).coalesce(1).select("id", text.alias("given")), "given"))
    assert tasks_of(made) >= 8
    for r in made.collect():
        if r.given is None:
            assert (r.matrix, r.size, r.text, r.error_code) == (None, None, None, "invalid-dimension")
        else:
            version = encode.fitting_version(r.given, "M")
            assert (r.text, r.version, r.size, r.error_code) == (r.given, version, 4 * version + 17, None)
