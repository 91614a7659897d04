"""Set-oriented forms of the frame stages: pixels, runs and symbols as rows, by windows and aggregates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .vision import COSINE, IMBALANCE, SPACING, SPREAD


def histogram(pixels: DataFrame, keys: list[str], luma: str = "luma") -> DataFrame:
    return pixels.groupBy(*keys, luma).agg(F.count("*").alias("n"))


def otsu(bins: DataFrame, keys: list[str], luma: str = "luma") -> DataFrame:
    """keys and threshold: one above the middle of the levels that part each histogram(keys, luma, n) best; 128 if none does."""
    levels = bins.select(*keys).distinct().withColumn(luma, F.explode(F.sequence(F.lit(0), F.lit(255))))
    full = levels.join(bins, [*keys, luma], "left").select(*keys, luma, F.coalesce("n", F.lit(0)).cast("double").alias("n"))
    upto = Window.partitionBy(*keys).orderBy(luma).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*keys)
    sums = full.select(*keys, luma, F.sum("n").over(upto).alias("b"), F.sum(F.col("n") * F.col(luma)).over(upto).alias("m"), F.sum("n").over(all_).alias("t"), F.sum(F.col("n") * F.col(luma)).over(all_).alias("s"))
    above = F.col("t") - F.col("b")
    part = F.when((F.col("b") > 0) & (above > 0), F.col("b") * above * F.pow(F.col("m") / F.col("b") - (F.col("s") - F.col("m")) / above, 2)).otherwise(F.lit(0.0))
    best = sums.withColumn("part", part).withColumn("best", F.max("part").over(all_)).filter("part = best")
    return best.groupBy(*keys).agg(F.when(F.max("best") > 0, F.shiftright((F.min(luma) + F.max(luma)).cast("int"), 1) + 1).otherwise(128).cast("int").alias("threshold"))


def runs(bits: DataFrame, keys: list[str], order: list[str], bit: str = "bit") -> DataFrame:
    """keys, run (from 0), bit, start (place of the first) and length of each run of equal bits."""
    line = Window.partitionBy(*keys).orderBy(*order)
    marked = bits.withColumn("_at", F.row_number().over(line) - 1).withColumn("_new", F.coalesce(F.col(bit) != F.lag(bit).over(line), F.lit(False)).cast("int"))
    numbered = marked.withColumn("run", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "run").agg(F.first(bit).alias(bit), F.min("_at").alias("start"), F.count("*").alias("length"))


def profiles(run_rows: DataFrame, keys: list[str], bit: str = "bit") -> DataFrame:
    """keys, run and score of each dark run that begins a 1:1:3:1:1 profile."""
    from ..functions.exprs import finder_score

    line = Window.partitionBy(*keys).orderBy("run")
    five = [F.col("length").cast("double"), *[F.lead("length", k).over(line).cast("double") for k in range(1, 5)]]
    out = run_rows.select(*keys, "run", bit, *[c.alias(f"r{i}") for i, c in enumerate(five)])
    return out.filter(F.col(bit) & F.col("r4").isNotNull()).withColumn("score", finder_score([F.col(f"r{i}") for i in range(5)])).filter("score is not null").select(*keys, "run", "score")


def integral(pixels: DataFrame, keys: list[str], x: str = "x", y: str = "y", value: str = "luma") -> DataFrame:
    """pixels with `total`: the sum over all pixels at or above and left of each."""
    along = Window.partitionBy(*keys, y).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys, x).orderBy(y).rowsBetween(Window.unboundedPreceding, 0)
    return pixels.withColumn("_row", F.sum(value).over(along)).withColumn("total", F.sum("_row").over(down)).drop("_row")


def downscale(pixels: DataFrame, keys: list[str], factor: int) -> DataFrame:
    """Box means of whole boxes, cut to integers; needs x, y, luma, width, height."""
    cell = [F.expr(f"cast({c} div {factor} as int)").alias(c) for c in "xy"]
    whole = pixels.filter(f"x < width div {factor} * {factor} and y < height div {factor} * {factor}")
    return whole.groupBy(*keys, *cell).agg(F.floor(F.sum("luma") / (factor * factor)).cast("int").alias("luma"))


def corner_triples(patterns: DataFrame, keys: list[str], pool: int = 12) -> DataFrame:
    """keys, top_left, top_right, bottom_left, score and place (from 1) of plausible symbols, best first.

    patterns: keys, pattern_id, x, y, module, count. The strongest `pool` patterns of each frame meet in a join on keys and
    ascending rank, so a frame gives a bounded number of triples.
    """
    strongest = Window.partitionBy(*keys).orderBy((F.col("count") * F.col("module")).desc(), "pattern_id")
    ranked = patterns.withColumn("_rank", F.row_number().over(strongest)).filter(F.col("_rank") <= pool)
    # a frame's pool is small: gather it, then combine within the row, instead of shuffling it three times
    item = F.struct(F.col("_rank").alias("rank"), F.col("pattern_id").alias("id"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "module")])
    pools = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_pool"))
    for name in "abc":
        after = F.lit(True) if name == "a" else F.col(f"_{name}.rank") > F.col(f"_{chr(ord(name) - 1)}.rank")
        pools = pools.withColumn(f"_{name}", F.explode("_pool")).filter(after)
    p = {n: F.col(f"_{n}") for n in "abc"}
    apart = lambda m, n: F.sqrt((p[m]["x"] - p[n]["x"]) * (p[m]["x"] - p[n]["x"]) + (p[m]["y"] - p[n]["y"]) * (p[m]["y"] - p[n]["y"]))
    sides = F.array_sort(F.array(*[F.struct(apart(m, n).alias("length"), F.lit(-i).alias("order"), p[o].alias("corner"), p[m].alias("m"), p[n].alias("n")) for i, (m, n, o) in enumerate(("bca", "acb", "abc"))]))
    s = pools.select(*keys, *[p[n].alias(f"_{n}") for n in "abc"], sides.alias("_s"))
    s = s.select("*", F.col("_s")[2]["corner"].alias("_o"), F.col("_s")[2]["m"].alias("_m"), F.col("_s")[2]["n"].alias("_n"), *[F.col("_s")[i]["length"].alias(f"_{k}") for i, k in enumerate(("short", "middle", "long"))])
    modules = [F.col(f"_{n}.module") for n in "abc"]
    s = s.withColumn("_mean", (modules[0] + modules[1] + modules[2]) / 3).withColumn("_spread", (F.greatest(*modules) - F.least(*modules)) / F.col("_mean"))
    side = lambda end: (F.col(f"_{end}.x") - F.col("_o.x"), F.col(f"_{end}.y") - F.col("_o.y"))
    (ux, uy), (vx, vy) = side("m"), side("n")
    s = s.withColumn("_leg", (F.col("_short") + F.col("_middle")) / 2)
    s = s.filter((F.col("_spread") <= SPREAD) & (F.col("_leg") / F.col("_mean")).between(*SPACING))
    s = s.withColumn("_legs", (F.col("_middle") - F.col("_short")) / F.col("_leg")).filter(F.col("_legs") <= IMBALANCE)
    s = s.withColumn("_cos", F.abs(ux * vx + uy * vy) / (F.col("_short") * F.col("_middle"))).filter(F.col("_cos") <= COSINE)
    diagonal = F.abs(F.col("_long") - math.sqrt(2) * F.col("_leg")) / F.col("_long")
    turn = ux * vy - uy * vx > 0
    end = lambda yes, no: F.when(turn, F.col(f"_{yes}.id")).otherwise(F.col(f"_{no}.id"))
    s = s.withColumn("score", F.col("_spread") + F.col("_legs") + 2 * diagonal + F.col("_cos"))
    best = Window.partitionBy(*keys).orderBy("score", "_a.rank", "_b.rank", "_c.rank")
    return s.select(*keys, F.col("_o.id").alias("top_left"), end("m", "n").alias("top_right"), end("n", "m").alias("bottom_left"), "score", F.row_number().over(best).alias("place"))


def best_triples(patterns: DataFrame, keys: list[str]) -> DataFrame:
    """The most plausible symbol of each frame; frames without one have no row."""
    return corner_triples(patterns, keys).filter("place = 1").drop("place")


def window_means(pixels: DataFrame, keys: list[str], width: int, height: int, tile: int, half: int) -> DataFrame:
    """keys, tx, ty and mean: of each tile of a frame the mean of the pixels at most `half` from its middle, each way.

    pixels: keys, x, y, luma. Four places of the integral image give a window's sum.
    """
    total = integral(pixels, keys).select(*keys, F.col("x").alias("_x"), F.col("y").alias("_y"), "total")
    span = lambda n: F.sequence(F.lit(0), F.lit((n - 1) // tile))
    tiles = pixels.select(*keys).distinct().withColumn("tx", F.explode(span(width))).withColumn("ty", F.explode(span(height)))
    low, high = ((lambda c, n, way=way: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col(c) * tile + tile // 2 + way * half))) for way in (-1, 1))
    tiles = tiles.withColumns({"x0": low("tx", width), "x1": high("tx", width), "y0": low("ty", height), "y1": high("ty", height)})
    corner = lambda x, y, sign: F.struct(x.alias("x"), y.alias("y"), F.lit(sign).alias("sign"))
    x0, x1, y0, y1 = F.col("x0") - 1, F.col("x1"), F.col("y0") - 1, F.col("y1")
    at = tiles.withColumn("c", F.explode(F.array(corner(x1, y1, 1), corner(x0, y1, -1), corner(x1, y0, -1), corner(x0, y0, 1))))
    at = at.select(*keys, "tx", "ty", ((x1 - x0) * (y1 - y0)).alias("pixels"), F.col("c.x").alias("_x"), F.col("c.y").alias("_y"), "c.sign").filter("_x >= 0 and _y >= 0")
    return at.join(total, [*keys, "_x", "_y"]).groupBy(*keys, "tx", "ty").agg((F.sum(F.col("sign") * F.col("total")) / F.first("pixels")).alias("mean"))


def distinct_places(found: DataFrame, keys: list[str], order: str, diagonal: str = "diagonal", x: str = "x", y: str = "y") -> DataFrame:
    """The rows that are no repeat of a row kept before: of the same keys, nearer than half the larger diagonal.

    keys should hold the frame and the text; a frame has few results, which one row folds in order.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("order"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(diagonal).cast("double").alias("d"), F.struct(*[c for c in found.columns if c not in keys]).alias("row"))))
    grouped = found.groupBy(*keys).agg(rows.alias("_rows"))

    def near(a, b):
        return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"])) < F.greatest(a["d"], b["d"]) / 2

    kept = F.aggregate("_rows", F.filter("_rows", lambda r: F.lit(False)), lambda acc, r: F.when(F.exists(acc, lambda k: near(k, r)), acc).otherwise(F.concat(acc, F.array(r))))
    out = grouped.select(*keys, F.explode(kept).alias("_k"))
    return out.select(*[F.col(c) if c in keys else F.col(f"_k.row.`{c}`").alias(c) for c in found.columns])


def data_modules(versions: DataFrame, centres: DataFrame) -> DataFrame:
    """version and the number of modules outside all function patterns, from qr_version and qr_alignment."""
    side = F.sequence(F.lit(0), F.col("size") - 1)
    cells = versions.select("version", "size", F.explode(side).alias("row")).withColumn("col", F.explode(side))
    low, high = lambda c: F.col(c) < 9, lambda c: F.col(c) >= F.col("size") - 8
    corner = (low("row") & low("col")) | (low("row") & high("col")) | (high("row") & low("col"))
    timing = (F.col("row") == 6) | (F.col("col") == 6)
    edge = lambda a, b: (F.col(a) < 6) & F.col(b).between(F.col("size") - 11, F.col("size") - 9)
    named = (F.col("version") > 6) & (edge("row", "col") | edge("col", "row"))
    ends = centres.groupBy("version").agg(F.min("centre").alias("first"), F.max("centre").alias("last"), F.collect_list("centre").alias("all"))
    near = lambda c: F.try_element_at(F.filter("all", lambda m: F.abs(m - F.col(c)) <= 2), F.lit(1))
    placed = cells.filter(~(corner | timing | named)).join(ends, "version", "left").select("version", "first", "last", near("row").alias("r"), near("col").alias("c"))
    at = lambda a, b: (F.col("r") == F.col(a)) & (F.col("c") == F.col(b))
    inside = F.col("r").isNotNull() & F.col("c").isNotNull() & ~(at("first", "first") | at("first", "last") | at("last", "first"))
    return placed.filter(~F.coalesce(inside, F.lit(False))).groupBy("version").agg(F.count("*").alias("modules"))


def poly_product(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, power and coefficient of the product of polynomials over the field; a and b: keys, power, coefficient."""
    from ..functions.exprs import gf_mul

    pairs = a.join(b.select(*keys, F.col("power").alias("_power"), F.col("coefficient").alias("_c")), keys)
    return pairs.groupBy(*keys, (F.col("power") + F.col("_power")).alias("power")).agg(F.bit_xor(gf_mul(F.col("coefficient"), F.col("_c"))).alias("coefficient"))
