"""Approximate nearest neighbours by balanced posting lists.

Centroids come from balanced splits of a bounded sample of vectors. Every vector goes to its nearest centroid's list, and
near a boundary to others too: those not much farther, unless a list already chosen lies closer to them than the vector
does. A query walks a graph of the centroids, made once and kept in memory by each task, and reads the lists whose centroid
is at most RATIO times as far as the best, and on until they hold ENOUGH vectors; where the walk ends before that ratio,
all centroids are compared, so no number of lists is the limit. Lists are cut into blocks, so none is too long for a task.
Equal vectors count as one while searching; of each, as many smallest ids are kept as a result can hold, which loses
nothing.

The number of lists grows with the vectors, one for LIST_ROWS, as long as their centroids fit a task (MOST_LISTS, a few MB
for each hundred dimensions). Beyond that, lists grow longer, in more blocks: every query still reads all that lies within
the ratio. Centroids are fitted on SAMPLE_ROWS vectors, or on LIST_SAMPLE for each list if that is more.

Scores are exact: cosines of the original vectors in double precision, equal vectors with equal scores; ties go to the
smaller id. Only which lists are read is approximate; the tests measure recall against brute force.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do vectors of
another dimension than most; rows with the same id and vector count once; a query's own id is no candidate; fewer
candidates than asked give all of them; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

SAMPLE_ROWS, LIST_SAMPLE, LIST_ROWS, MOST_LISTS = 20_000, 8, 128, 32_768
REPLICAS, BOUNDARY, RATIO, ENOUGH, BEAM, LINKS, BLOCK_ROWS = 6, 1.15, 1.22, 256, 96, 24, 8192


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(x: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Unit centroids of lists of about equal size: each part is split in two halves along two of its means."""
    rng, parts = np.random.default_rng(seed), [(np.arange(len(x)), lists)]
    out = []
    while parts:
        rows, k = parts.pop()
        if k <= 1 or len(rows) < 2:
            out.append(x[rows].mean(0))
            continue
        a, b = x[rng.choice(rows, 2, replace=False)]
        for _ in range(6):
            side = x[rows] @ (a - b)
            cut = np.partition(side, len(rows) // 2)[len(rows) // 2]
            left = side < cut
            if not left.any() or left.all():
                left = np.arange(len(rows)) < len(rows) // 2
            a, b = x[rows[~left]].mean(0), x[rows[left]].mean(0)
        parts += [(rows[left], k // 2), (rows[~left], k - k // 2)]
    c = np.array(out)
    size = np.linalg.norm(c, axis=1, keepdims=True)
    return np.where(size > 1e-12, c / np.maximum(size, 1e-12), np.eye(1, c.shape[1]))


class Graph:
    """Centroids with links to their nearest others; search walks the links, best first."""

    def __init__(self, c: np.ndarray, links: int = LINKS):
        self.c, k = c, min(links, len(c) - 1)
        self.links = np.zeros((len(c), k), np.int32)
        for a in range(0, len(c) if k else 0, 1024):  # a bounded number of rows of all distances at a time
            near = c[a : a + 1024] @ c.T
            near[np.arange(len(near)), np.arange(a, a + len(near))] = -2
            some = np.argpartition(-near, k - 1, 1)[:, :k]
            self.links[a : a + 1024] = np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, 1), 1, kind="stable"), 1)
        step = max(1, len(c) // 16)
        self.doors = np.arange(0, len(c), step)  # places to start, all over the graph

    def search(self, q: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(lists, distances) nearest first, as far as a beam of this width comes."""
        if len(self.c) <= beam:
            d = far(self.c @ q)
            order = np.argsort(d, kind="stable")
            return order, d[order]
        seen = np.zeros(len(self.c), bool)
        seen[self.doors] = True
        start = far(self.c[self.doors] @ q)
        todo = [(float(d), int(i)) for d, i in zip(start, self.doors, strict=True)]
        heapq.heapify(todo)
        best = sorted(todo)[:beam]
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= beam and d > best[beam - 1][0]:
                break
            new = self.links[i][~seen[self.links[i]]]
            seen[new] = True
            fresh = [(float(x), int(j)) for x, j in zip(far(self.c[new] @ q), new, strict=True)]
            for x in fresh:
                heapq.heappush(todo, x)
            best = sorted(best + fresh)[:beam]
        return np.array([i for _, i in best]), np.array([d for d, _ in best])


def far(cosine: np.ndarray) -> np.ndarray:
    """The distance of unit vectors."""
    return np.sqrt(np.maximum(0, 2 - 2 * cosine))


def chosen(graph: Graph, q: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The lists to read, nearest first: all within RATIO, and on until they hold ENOUGH vectors; own: vectors by list."""
    near, d = graph.search(q)
    if d[-1] <= RATIO * d[0]:  # the beam was too narrow; one as wide as the graph compares all centroids
        near, d = graph.search(q, len(graph.c))
    n = int((d <= RATIO * d[0]).sum())
    while own[near[:n]].sum() < ENOUGH and n < len(graph.c):
        if n == len(near):
            near, d = graph.search(q, len(graph.c))
        n += 1
    return near[:n]


def members(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, list, is its first) for each list that a row of unit vectors x belongs to."""
    d = far(x @ c.T)
    k = min(REPLICAS, len(c))
    near = np.argpartition(d, k - 1, 1)[:, :k]
    near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), 1, kind="stable"), 1)
    dist = np.take_along_axis(d, near, 1)
    take = dist <= BOUNDARY * dist[:, :1]
    between = far(np.einsum("nkd,njd->nkj", c[near], c[near]))
    for j in range(1, k):
        for i in range(1, j):  # the first list stands for itself only; boundary vectors are what is wanted
            take[:, j] &= ~(take[:, i] & (between[:, i, j] < 0.5 * dist[:, j]))
    row, col = np.nonzero(take)
    return row, near[row, col], col == 0


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision, in an order that depends on the two vectors alone."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    size = lambda v: np.sqrt((v * v).sum(-1))
    return np.clip((a * b).sum(-1) / (size(a) * size(b)), -1.0, 1.0)


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, v (bytes of single-precision components) and dim of the vectors that take part."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw, dims = [], [], []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
                if i is None or not v.is_valid or not len(v.values) or v.values.null_count:
                    continue
                x = np.asarray(v.values, np.float32)
                if np.isfinite(x).all() and x.any():
                    x = x + np.float32(0)  # no negative zeros: equal vectors have equal bytes
                    ids.append(i)
                    raw.append(x.tobytes())
                    dims.append(len(x))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary()), pa.array(dims, pa.int32())], names=["vec_id", "v", "dim"])

    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(clean, "vec_id bigint, v binary, dim int")


def matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(-1, dim)


def nearest(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    result = "query_id bigint, rank int, vec_id bigint, score double"
    all_ = staged(valid(vectors), "vectors")
    dims = all_.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], result)
    dim = dims[0].dim
    part = all_.filter(F.col("dim") == dim).select("vec_id", "v")
    # the k + 1 smallest ids of each distinct vector: rows beyond them are dropped before they move
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    one = part.withColumn("place", place).filter(F.col("place") <= k + 1)
    same = staged(one.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")), "distinct-vectors")
    distinct = same.count()
    lists = int(min(MOST_LISTS, max(1, distinct // LIST_ROWS)))
    sample = same.select("v").orderBy(F.xxhash64("v"), "v").limit(max(SAMPLE_ROWS, LIST_SAMPLE * lists)).collect()
    c = centroids(unit(matrix((r.v for r in sample), dim).astype(np.float64)), lists)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                piece = batch.slice(i, 512)
                row, to, first = members(unit(matrix(piece.column("v").to_pylist(), dim).astype(np.float64)), c)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(first), piece.column("v").take(at), piece.column("ids").take(at)], names=["list", "first", "v", "ids"])

    postings = staged(same.mapInArrow(assign, "list int, first boolean, v binary, ids array<bigint>"), "posting-lists")
    sizes = {r["list"]: (r["n"], r["own"]) for r in postings.groupBy("list").agg(F.count("*").alias("n"), F.sum(F.col("first").cast("int")).alias("own")).collect()}  # a row a list
    own = np.array([sizes.get(i, (0, 0))[1] for i in range(len(c))])
    blocks = np.array([-(-sizes.get(i, (0, 0))[0] // BLOCK_ROWS) for i in range(len(c))])

    graph = Graph(c)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to, block, raw = [], [], []
            for v in batch.column("v").to_pylist():
                q = unit(np.frombuffer(v, np.float32).astype(np.float64)[None])[0]
                for j in chosen(graph, q, own).tolist():
                    for b in range(blocks[j]):
                        to.append(j)
                        block.append(b)
                        raw.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(block, pa.int32()), pa.array(raw, pa.binary())], names=["list", "block", "q"])

    queries = part.filter(F.col("vec_id") % every == 0).dropDuplicates()
    asked = queries.select("v").distinct().mapInArrow(probe, "list int, block int, q binary")
    number = F.element_at(F.expr(f"cast(split('{','.join(map(str, np.maximum(1, blocks).tolist()))}', ',') as array<int>)"), F.col("list") + 1)
    spread = postings.select("list", F.pmod(F.xxhash64("v"), number).cast("int").alias("block"), "v", "ids")

    def match(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(ask) and len(have):
            v, ids = matrix(have.v, dim), have.ids.tolist()
            u = unit(v.astype(np.float64))
            for i in range(0, len(ask), 256):
                q = matrix(ask.q[i : i + 256], dim)
                rough = unit(q.astype(np.float64)) @ u.T
                for row, mine, raw in zip(rough, q, ask.q[i : i + 256], strict=True):
                    least = np.partition(row, len(row) - k - 1)[len(row) - k - 1] if len(row) > k + 1 else -2
                    at = np.flatnonzero(row >= least - 1e-9)
                    found = [(-s, j) for s, z in zip(cosine(mine[None], v[at]).tolist(), at.tolist(), strict=True) for j in ids[z]]
                    out += [(raw, j, -s) for s, j in heapq.nsmallest(k + 1, found)]
        return pd.DataFrame(out, columns=["q", "vec_id", "score"])

    found = asked.groupBy("list", "block").cogroup(spread.groupBy("list", "block")).applyInPandas(match, "q binary, vec_id bigint, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    merged = found.withColumn("place", F.dense_rank().over(best)).filter(F.col("place") <= k + 1).select("q", "vec_id", "score").distinct()
    met = queries.withColumnRenamed("vec_id", "query_id").join(merged, F.col("v") == F.col("q")).filter(F.col("query_id") != F.col("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id", "v").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
