"""The corpus pipeline: documents to packed training sequences, in stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; run() writes each stage's rows to
the shared folder and reads them again. Toxic documents go; of near copies (five-word shingles, similarity 0.8 or more)
one stays; repeated strings are cut; sources are mixed to their target weights; the rest is packed into windows.

Defined results: a null or empty text, or one without words, isn't toxic, near no other and holds no repeats, so it stays
until the mix, which gives it as often as its source asks, and packs as its end id alone; rows that repeat an id and text
are copies of one another; a null doc_id counts as the smallest id; other columns are carried along; an empty table gives
no rows in any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matrixlake.llm import mixing, ngram_join, packing, repeats, toxicity
from matrixlake.llm.common import discard, scratch, ship, staged, table
from matrixlake.llm.queries import BYTE_VOCABULARY, vocabulary


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return ngram_join.one_of_each(docs, words=5, num=80, den=100)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return repeats.without_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.mixture(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs, vocabulary(BYTE_VOCABULARY), 0)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_join", without_near_copies),
    ("repeats", without_repeats),
    ("mixing", mixed),
    ("packing", packed),
]
#: Learned scores, links and tokens aren't expressible in SQL. Tests hold the operators behind the stages against plain
#: versions (toxicity's given a model), and the stages together to odd rows and to the sums of their windows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch() as s:  # what a stage has staged on its way goes with its end
            docs = s.keep(staged(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        if last is not None:
            discard(last)
        last = docs
    return docs
