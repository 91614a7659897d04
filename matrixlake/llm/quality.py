"""Quality scores: histogram gradient-boosted trees over statistics of whole texts.

Statistics come from all bytes and words of a text (numpy, a slice of texts at a time). Training bins each statistic by
quantiles, grows trees of a fixed depth on histograms of gradients, and lays all trees out in three arrays, node i's
children at 2i+1 and 2i+2, so scoring is DEPTH gathers for each tree over a whole batch.

Only statistics enter a score. The trainer sees at most `rows` labelled documents, chosen by a hash of the id.
Defined results: a null or empty text has all statistics 0 and gets the score of such a text; labels that are null or not
0 or 1 are left out, several labels of an id count as the largest; without any label of one kind the score is the share
of label 1 (0.5 without labels); repeated rows are scored each; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import remainder, staged

SAMPLE_ROWS, TREES, DEPTH, BINS, RATE, LEAF_ROWS, RIDGE = 20_000, 80, 4, 64, 0.12, 12, 1.0
_KINDS = [b" \t\r\x0b\x0c", b"\n", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".", b",", b"!?", b"|", b"#$%&*@~^=+<>\\/", b"\"'()[]{}`", b"-_:;"]
KIND = np.full(256, 14, np.int64)
for _i, _k in enumerate(_KINDS):
    KIND[list(_k)] = _i
KIND[0x80:0xC0], KIND[0xC0:] = 13, 12
#: Words that can be told from one another only by their case or marks count as one.
NAMES = ["chars", "words", *(f"share_{i}" for i in range(15) if i != 13), "word_mean", "word_spread", "word_max", "same_as_last", "same_as_second_last", "distinct", "top_word", "upper_words", "marked_words", "line_words", "entropy"]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    kinds = KIND[data]
    kinds += np.repeat(np.arange(n) * 16, sizes)
    count = np.bincount(kinds, minlength=16 * n).reshape(n, 16).astype(np.float64)
    chars = count.sum(1) - count[:, 13]
    w = ta.words(data, offsets)
    of, length = np.repeat(np.arange(n), w.counts()), (w.ends - w.starts).astype(np.float64)
    number = w.counts().astype(np.float64)
    per = lambda x: np.bincount(of, x, n) / np.maximum(number, 1)
    mean = per(length)
    spread = np.sqrt(np.maximum(0, per(length**2) - mean**2))
    longest = np.zeros(n)
    np.maximum.at(longest, of, length)
    h = ta.word_hashes(ta.LOWER[data], w)
    same1, same2 = np.zeros(len(h)), np.zeros(len(h))
    same1[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    same2[2:] = (h[2:] == h[:-2]) & (of[2:] == of[:-2])
    distinct, top, entropy = np.zeros(n), np.zeros(n), np.zeros(n)
    for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
        if b > a:
            s = np.sort(h[a:b])
            runs = np.diff(np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]])))
            p = runs / (b - a)
            distinct[i], top[i], entropy[i] = len(runs) / (b - a), p.max(), -(p * np.log(p)).sum()
    firsts = data[w.starts] if len(w.starts) else np.zeros(0, np.uint8)
    lasts = data[w.ends - 1] if len(w.starts) else np.zeros(0, np.uint8)
    upper = ((firsts >= 65) & (firsts <= 90)).astype(float)
    marked = np.isin(KIND[lasts], [7, 8, 9, 10]).astype(float)
    share = np.delete(count[:, :15], 13, 1) / np.maximum(chars, 1)[:, None]
    rest = [mean, spread, longest, per(same1), per(same2), distinct, top, per(upper), per(marked), number / (count[:, 1] + 1), entropy]
    return np.column_stack([np.log1p(chars), np.log1p(number), share, *rest]).astype(np.float32)


@dataclass
class Trees:
    feature: np.ndarray  # trees x nodes
    cut: np.ndarray
    value: np.ndarray  # trees x leaves
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total, row = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[row, feature[node]] > cut[node])
            total += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boosted trees for the logistic loss, grown level by level on histograms."""
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        share = min(max(share, 1e-6), 1 - 1e-6)
        empty = np.zeros((0, 2**depth - 1))
        return Trees(empty.astype(int), empty, np.zeros((0, 2**depth)), float(np.log(share / (1 - share))), depth)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    code = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])  # x <= edge k has a code of k at most
    n, m = x.shape
    out = Trees(np.zeros((trees, 2**depth - 1), int), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth)), float(np.log(share / (1 - share))), depth)
    at = np.full(n, out.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-at))
        g, h, node = p - y, p * (1 - p), np.zeros(n, int)
        for level in range(depth):
            k = 2**level
            best, gain0 = [(0, np.inf, -1)] * k, np.full(k, 1e-9)
            for f in range(m):
                key = node * bins + code[:, f]
                G, H, C = (np.bincount(key, v, k * bins).reshape(k, bins).cumsum(1) for v in (g, h, None))
                left, right = G[:, :-1], G[:, -1:] - G[:, :-1]
                gain = left**2 / (H[:, :-1] + RIDGE) + right**2 / (H[:, -1:] - H[:, :-1] + RIDGE) - G[:, -1:] ** 2 / (H[:, -1:] + RIDGE)
                gain[(C[:, :-1] < LEAF_ROWS) | (C[:, -1:] - C[:, :-1] < LEAF_ROWS)] = -1
                gain = gain[:, : len(edges[f])]
                if gain.shape[1]:
                    j = gain.argmax(1)
                    for i in np.flatnonzero(gain[np.arange(k), j] > gain0):
                        gain0[i] = gain[i, j[i]]
                        best[i] = (f, float(edges[f][j[i]]), int(j[i]))
            first = k - 1
            out.feature[t, first : first + k] = [b[0] for b in best]
            out.cut[t, first : first + k] = [b[1] for b in best]
            split_f, split_c = np.array([b[0] for b in best])[node], np.array([b[2] if b[2] >= 0 else bins for b in best])[node]
            node = 2 * node + (code[np.arange(n), split_f] > split_c)
        G, H = np.bincount(node, g, 2**depth), np.bincount(node, h, 2**depth)
        out.value[t] = -rate * G / (H + RIDGE)
        at += out.value[t][node]
    return out


def labelled(labels: DataFrame, column: str, folds: int, held_out: int, rows: int) -> DataFrame:
    """At most `rows` (doc_id, label) outside the held-out fold, the first by a hash of the id."""
    kept = labels.filter(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", folds) != held_out))
    one = kept.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(column).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, held_out: int = 0, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data, offsets in ta.slices(batch.column("text")):
                x = statistics(data, offsets)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, len(x)), flat], names=["doc_id", "x"])

    measured = staged(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(measure, "doc_id bigint, x array<float>"), "quality-statistics")
    sample = F.broadcast(labelled(labels, "quality", folds, held_out, rows))  # `rows` at most
    seen = measured.join(sample, "doc_id").select("x", "label").toArrow()
    x = np.asarray(seen["x"].combine_chunks().flatten(), np.float32).reshape(len(seen), -1) if len(seen) else np.zeros((0, len(NAMES)), np.float32)
    model = train(x, np.asarray(seen["label"], np.float64) if len(seen) else np.zeros(0))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(values))], names=["doc_id", "score"])

    out = measured.mapInArrow(apply, "doc_id bigint, score double")
    return out.select("doc_id", F.coalesce(remainder("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
