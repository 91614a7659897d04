"""Language by rank-order profiles: out-of-place distances of a text's most frequent n-grams to each language's.

A text's letters, lower-cased, make words; words with a blank at each side give n-grams of 1 to 3 letters. The PROFILE
most frequent of them, by rank, are compared to each language's profile: an n-gram costs the difference of its ranks, or
PROFILE if the profile lacks it. The nearest language wins; the score is the margin to the next, between 0 and 1.

Profiles come from about `rows` documents of each language outside the held-out fold, chosen by a hash of the id.
Defined results: a text that is null, empty or without a letter is `und` with score 0; ties go to the first language by
code point; without any labelled document all is `und`; one known language scores 1 when it shares an n-gram with the
text; repeated rows are judged each; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder

PROFILE, SAMPLE_ROWS, SLICE = 300, 1500, 1 << 18
BLANK, BITS = 1, 21  # three code points of 21 bits fill 63


@cache
def _letters() -> np.ndarray:
    """Lower case of each letter, 0 for all other code points."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the text, as numbers, and how often they occur."""
    found, total = [], 0
    for a in range(0, len(text), SLICE):  # a long text in slices; each begins a little early so that no n-gram is lost
        lead = min(a, 3)
        c = np.frombuffer(text[a - lead : a + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = _letters()[np.minimum(c, 0x10FFFF)]
        letters = np.concatenate([letters[:0] if lead else [BLANK], np.where(letters == 0, BLANK, letters), [BLANK] if a + SLICE >= len(text) else []]).astype(np.int64)
        one, two = letters, (letters[:-1] << BITS) | letters[1:]
        three = (two[:-1] << BITS) | letters[2:]
        fresh1, fresh2, fresh3 = (max(0, lead - k + 1) if lead else 0 for k in (1, 2, 3))
        one, two, three = one[fresh1:], two[fresh2:], three[fresh3:]
        keep1 = one != BLANK
        keep2 = two != ((BLANK << BITS) | BLANK)
        mid = (three >> BITS) & ((1 << BITS) - 1)
        keep3 = mid != BLANK
        found.append(np.sort(np.concatenate([one[keep1], two[keep2], three[keep3]])))
        total += len(found[-1])
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    every = found[0] if len(found) == 1 else np.sort(np.concatenate(found))
    at = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1], [True]]))
    return every[at[:-1]], np.diff(at)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by number."""
    if len(keys) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))[:size]]


class Profiles:
    def __init__(self, ranks: dict[str, list[int]], size: int = PROFILE):
        self.langs, self.size = sorted(ranks), size
        self.keys = np.array(sorted({k for r in ranks.values() for k in r}), np.int64)
        self.rank = np.full((len(self.langs), len(self.keys) + 1), -1)  # the last column: in no profile
        for i, lang in enumerate(self.langs):
            self.rank[i, np.searchsorted(self.keys, ranks[lang])] = np.arange(len(ranks[lang]))

    def judge(self, text: str | None) -> tuple[str, float]:
        keys = ranked(*grams(text), self.size) if text and self.langs else ()
        if not len(keys):
            return "und", 0.0
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        at[self.keys[at] != keys] = len(self.keys)
        there = self.rank[:, at]
        far = np.where(there < 0, self.size, np.abs(there - np.arange(len(keys)))).sum(1) / (self.size * len(keys))
        order = np.argsort(far, kind="stable")
        next_ = far[order[1]] if len(far) > 1 else 1.0
        best = float(far[order[0]])
        return self.langs[order[0]], min(1.0, max(0.0, float(next_ - best) / max(next_, 1e-9)))


def profiles(docs: DataFrame, folds: int = 4, held_out: int = 2, rows: int = SAMPLE_ROWS, size: int = PROFILE) -> Profiles:
    """Learns a profile for each language from about `rows` documents of it."""
    learn = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", folds) != held_out))
    number = {r.lang: r.n for r in learn.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not number:
        return Profiles({}, size)
    share = learn.sparkSession.createDataFrame([(k, rows / n) for k, n in number.items()], "lang string, share double")
    point = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    some = learn.join(F.broadcast(share), "lang").filter(point < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, dict[int, int]] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                mine = seen.setdefault(lang, {})
                for k, n in zip(*(x.tolist() for x in grams(text)), strict=True):
                    mine[k] = mine.get(k, 0) + n
        for lang, mine in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(mine)), pa.array(list(mine), pa.int64()), pa.array(list(mine.values()), pa.int64())], names=["lang", "gram", "n"])

    counts = some.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    from pyspark.sql.window import Window

    # n-grams of 3 letters: a language has a bounded number of rows here, and the first rows are picked before they move
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    ranks: dict[str, list[int]] = {}
    for r in counts.withColumn("place", place).filter(F.col("place") <= size).orderBy("lang", "place").collect():
        ranks.setdefault(r.lang, []).append(r.gram)
    return Profiles(ranks, size)


def predictions(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    known = profiles(docs, folds, held_out)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                got = [known.judge(t) for t in batch.column("text").slice(i, 1000).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1000), pa.array([x[0] for x in got]), pa.array([x[1] for x in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(judge, "doc_id bigint, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(remainder("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
