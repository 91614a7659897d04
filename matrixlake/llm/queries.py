"""The registered queries of the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import imatch, language, mixing, neighbours, ngram_join, packing, quality, repeats, token_files, toxicity
from .common import scratch, staged, table

#: Where the public vocabularies are; a parameter of the operators that use one.
WORD_VOCABULARY, BYTE_VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_files.read_token_files(token_files.write_token_files(docs, vocabulary(WORD_VOCABULARY), 2))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("rest", "kept")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predictions(table(spark, sf_dir, "documents"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY), 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tidy(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with its rows written to the shared folder, and all that it staged on the way deleted."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with scratch() as s:
            return s.keep(staged(query(spark, sf_dir), query.__name__))

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": tidy(op1_quality),
    "op2_token_files": tidy(op2_token_files),
    "op3_ngram_join": op3_ngram_join,
    "op4_repeats": tidy(op4_repeats),
    "op5_fingerprints": op5_fingerprints,
    "op6_language": op6_language,
    "op7_neighbours": tidy(op7_neighbours),
    "op8_mixing": tidy(op8_mixing),
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
}
ORACLES: dict[str, str] = {"op8_mixing": mixing.ORACLE}
