import numpy as np
from pyspark.sql import functions as F

from matrixlake.functions import exprs, register
from matrixlake.operators import encode


def test_sql_names(spark):
    register.register(spark)
    m = encode.encode("HELLO", "M")
    g = encode.render(m)
    rows = [(1, bytearray(m.astype(np.uint8).tobytes()), bytearray(encode.rgba(g)), g.shape[1], g.shape[0]), (2, None, None, 1, 1)]
    spark.createDataFrame(rows, "id int, matrix binary, data binary, width int, height int").createOrReplaceTempView("frames")
    got = spark.sql("SELECT id, d.text, d.error_code FROM (SELECT id, qr_decode_matrix(matrix) AS d FROM frames) ORDER BY id").collect()
    assert [tuple(r) for r in got] == [(1, "HELLO", None), (2, None, "invalid-dimension")]
    got = spark.sql("SELECT id, t.text, t.version FROM frames, LATERAL qr_scan(data, width, height) t").collect()
    assert [tuple(r) for r in got] == [(1, "HELLO", 1)]
    assert spark.table("qr_version").count() == 40


def test_element_points(spark):
    df = spark.createDataFrame([("contain",), ("cover",), ("fill",), ("none",), ("scale-down",)], "fit string")
    at = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.lit(100.0).alias("x"), F.lit(50.0).alias("y")))
    points = exprs.element_points(at, F.col("fit"), (F.lit(100.0), F.lit(50.0)), (F.lit(200.0), F.lit(200.0)))
    got = {r.fit: [(p.x, p.y) for p in r.p] for r in df.select("fit", points.alias("p")).collect()}
    assert got == {"contain": [(0, 50), (200, 150)], "cover": [(-100, 0), (300, 200)], "fill": [(0, 0), (200, 200)], "none": [(50, 75), (150, 125)], "scale-down": [(50, 75), (150, 125)]}
    zero = exprs.element_points(at, F.lit("fill"), (F.lit(0.0), F.lit(50.0)), (F.lit(200.0), F.lit(200.0)))
    assert [(p.x, p.y) for p in spark.range(1).select(zero.alias("p")).first().p] == [(0, 0), (100, 50)]
