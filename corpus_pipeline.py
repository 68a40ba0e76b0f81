"""A training corpus from ``documents`` in five stages.

Each stage is a function of (spark, docs, sf_dir) that works on all rows its
predecessor kept and gives a DataFrame; its output is written as Parquet and
read again as the next stage's ``docs``.  All stages but the last give the
columns of ``documents``:

1. quality classifier: documents that it rejects go;
2. exact dedup: of equal texts the row with the largest id stays;
3. near-dedup: of each component of texts with similar five-word shingles the
   row with the smallest id stays (:mod:`waylace.llm.shingle_dedup`: the
   SimHash index of ``op2_simhash_near_dedup`` on five-word shingles, and a
   wider one for the pairs that 64 bits miss);
4. mixing: a row for each pass that the mix makes over a document, with the
   words that the pass takes (the whole text where it takes all of them);
5. byte-level BPE: the rows of the mix with their token ids, and the SHA-256 of
   the ids' decoding.

Nulls, empty texts, repeated rows and further columns have the results that the
operators' own modules state; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waylace.llm import bpe, exact_dedup, mixing, quality, shingle_dedup
from waylace.plans.scratch import materialize

#: The models, draws and vocabulary of the stages are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the threshold."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates."""
    return shingle_dedup.keep_one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents."""
    return mixing.mixed_documents(docs)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with ``token_ids`` and ``decoded_sha256``."""
    return bpe.append_ids(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_deduplication),
    ("SimHash near-dedup", near_deduplication),
    ("mixing sources to target weights", source_mixing),
    ("byte-level BPE encoding and decoding", byte_level_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
