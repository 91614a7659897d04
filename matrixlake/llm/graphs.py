"""Connected components of a table of links, by joins and aggregates alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, few, staged


CHUNK = 500_000


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task, a bounded number at a time, as stars: each node with the smallest that it reaches there."""

    def stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
        one, two = flat[: len(a)], flat[len(a) :]
        root = np.arange(len(nodes))
        while True:  # roots sink to the smaller of each link's two, then every node looks at its root's root
            low = np.minimum(root[one], root[two])
            before = root.copy()
            np.minimum.at(root, before[one], low)
            np.minimum.at(root, before[two], low)
            root = root[root]
            if (root == before).all():
                break
        apart = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[apart]), pa.array(nodes[root[apart]])], names=["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append((np.asarray(batch.column("a")), np.asarray(batch.column("b"))))
        n += batch.num_rows
        if n >= CHUNK:
            yield stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, n = [], 0
    if n:
        yield stars(*(np.concatenate(x) for x in zip(*held, strict=True)))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b), 64-bit numbers: the smallest node that it reaches.

    Each task first turns its own links into stars. Then rounds of the two star operations: a node links its larger
    neighbours to its smallest, then each node its smaller neighbours to the smallest of them. Each round is written to
    the shared folder, in files by the number of links; they end as stars, which another round leaves as they are.
    """

    def written(df: DataFrame, rows: int) -> tuple[DataFrame, tuple]:
        out = staged(few(df, rows), "links")
        return out, tuple(out.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

    now, mark = written(links.filter(F.col("a") != F.col("b")).mapInArrow(_forests, "u bigint, v bigint").distinct(), links.count())
    last = None
    while mark[0] and mark != last:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, last = now, mark
        now, mark = written(small.union(low.toDF("u", "v")).distinct(), mark[0])  # a round never adds links
        discard(old)
    return now.toDF("node", "root").union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
