"""Mixing of sources to target weights by hash-threshold histograms.

Each source gets a target number of words. A document is taken as often as its source's target holds the whole source,
and once more if its hash lies at or below the source's threshold. The threshold comes from histograms: words summed by
source and leading bits of the hash find the bucket where the budget ends, and only that bucket is split by further bits
until it holds one hash. Nothing is sorted; the documents are filtered as they are read. A smaller budget takes a subset of what a larger takes.

The hash is the first 60 bits of MD5 of the id, so reruns agree and SQL elsewhere can state the same choice.
Defined results: a null text has size 0; a null source is a source of its own, after all others; rows with the same id
share a hash and are taken or left together; null ids hash alike; an empty table gives no rows; a source without words
gets target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

HASH_BITS, LEVEL_BITS = 60, 12
WEIGHTS, STOP = (1, 2, 3), 3
#: Sources up to this number are broadcast (a few dozen bytes each); beyond it they are joined by shuffle.
BROADCAST_SOURCES = 50_000


def size(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def hashed(doc_id: str = "doc_id") -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, stop: int = STOP) -> dict[str | None, float]:
    """Water filling: shares by weight of all words, stopped at `stop` times a source's words, the excess shared anew."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    share = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, weight, out = sum(sizes.values()), sum(share.values()), dict.fromkeys(order, 0.0)
    for s in sorted(order, key=lambda s: (stop * sizes[s] / share[s], s is None, s or "")):
        level = left / weight
        if stop * sizes[s] / share[s] > level:
            break
        out[s] = float(stop * sizes[s])
        left -= stop * sizes[s]
        weight -= share[s]
        del share[s]
    for s in share:
        out[s] = share[s] * level
    return out


def thresholds(docs: DataFrame) -> DataFrame:
    """One row a source: source, source_size, target, whole (times all is taken), threshold (hashes up to it once more)."""
    spark = docs.sparkSession
    kept = staged(docs.select("source", size().alias("size"), hashed().alias("hash")), "mix-sizes")
    totals = {r.source: r.total for r in kept.groupBy("source").agg(F.sum("size").alias("total")).collect()}  # a row a source
    rows = []
    for s, target in targets(totals).items() if totals else ():
        whole = min(STOP, int(target // totals[s])) if totals[s] else 0
        rows.append((s, totals[s], target, whole, target - whole * totals[s]))
    plan = {r[0]: [*r, 0, -1, 0] for r in rows}  # ..., bits known, their value, words before the bucket
    decided: dict[str | None, int] = {r[0]: -1 for r in rows if not r[1] or r[4] <= 0}
    bits = 0
    while len(decided) < len(rows):
        bits += LEVEL_BITS
        going = [(s, int(p[6]), float(p[4]), int(p[7])) for s, p in plan.items() if s not in decided]
        edge = _small(spark.createDataFrame(going, "source string, prefix bigint, budget double, before bigint"), len(going))
        rest = HASH_BITS - bits
        at = F.shiftright("hash", rest + LEVEL_BITS)
        within = kept.alias("k").join(edge.alias("e"), F.col("k.source").eqNullSafe(F.col("e.source")) & (F.lit(bits == LEVEL_BITS) | (at == F.col("prefix"))))
        histogram = within.groupBy("e.source", "budget", "before", F.shiftright("hash", rest).alias("bucket")).agg(F.sum("size").alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        order = Window.partitionBy("source").orderBy("bucket")  # a source has 2^LEVEL_BITS buckets at most
        upto = F.col("before") + F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
        ranked = histogram.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("n"))
        # the last bucket that begins below the budget holds the end; all before it are taken
        ends = ranked.filter((F.col("from") < F.col("budget")) | (F.col("from") == F.col("before"))).groupBy("source").agg(F.max(F.struct("bucket", "from", "upto", "low", "high")).alias("b")).collect()
        for r in ends:
            p, b = plan[r.source], r.b
            if b.low == b.high:  # one hash: nearer with it or without it
                decided[r.source] = b.high if b["from"] + b.upto < 2 * p[4] else b.low - 1
            else:
                p[6], p[7] = b.bucket, b["from"]
    out = [(*plan[s][:4], decided[s]) for s in plan]
    return _small(spark.createDataFrame(out, "source string, source_size bigint, target double, whole bigint, threshold bigint"), len(out))


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_SOURCES else df


def mixed(docs: DataFrame) -> DataFrame:
    """docs with size, source_size, target, copies and taken; the documents' own columns stay as they are."""
    plan = thresholds(docs).select(*(F.col(c).alias(f"_{c}") for c in ("source", "source_size", "target", "whole", "threshold")))
    own = [F.col(f"d.{c}") for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    joined = docs.withColumns({"_size": size(), "_hash": hashed()}).alias("d").join(plan, F.col("d.source").eqNullSafe(F.col("_source")))
    copies = F.col("_whole") + (F.col("_hash") <= F.col("_threshold")).cast("bigint")
    return joined.select(*own, F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), copies.alias("copies"), (copies * F.col("_size")).alias("taken"))


def mixture(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of docs, with all their columns, as often as they are taken."""
    out = mixed(docs).filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS weight FROM s),
r AS (SELECT *, 3 * source_size / weight AS ratio FROM w),
c AS (SELECT *, coalesce(sum(3 * source_size) OVER before, 0) AS capped, coalesce(sum(weight) OVER before, 0) AS gone FROM r
      WINDOW before AS (ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) - capped)::BIGINT / ((SELECT sum(weight) FROM w) - gone)::BIGINT AS level FROM c),
m AS (SELECT coalesce(max(level) FILTER (ratio > level), 0) AS level FROM l),
t AS (SELECT l.source, l.source_size, CASE WHEN l.ratio > m.level AND m.level > 0 THEN l.weight * m.level ELSE (3 * l.source_size)::DOUBLE END AS target FROM l, m),
b AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(3, floor(target / source_size))::BIGINT END AS whole FROM t),
g AS (SELECT source, h, sum(size)::BIGINT AS n FROM d GROUP BY source, h),
u AS (SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
x AS (SELECT b.source, max(h) FILTER (2 * upto - n < 2 * (target - whole * source_size)) AS threshold
      FROM b LEFT JOIN u ON u.source IS NOT DISTINCT FROM b.source GROUP BY b.source)
SELECT d.doc_id, d.size, b.source_size, b.target,
       d.size * (b.whole + CASE WHEN d.h <= coalesce(x.threshold, -1) AND b.target > b.whole * b.source_size THEN 1 ELSE 0 END)::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""
