"""From raw documents to token ids: language, exact copies, near copies, benchmark leaks, tokens.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again
as the next one's docs.  All but the last return rows of documents unchanged; the last one
returns doc_id, n_tokens, ids, ids_sha256 and decoded_sha256 of every row that is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docatlas.llm import bpe, decontaminate, exact_dedup, language_id, ngram_join
from docatlas.llm.common import stored


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a letter, or without a language of at least even odds, go."""
    return language_id.accepted(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.dedup(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays."""
    return ngram_join.dedup(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that overlap with a benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.report(docs, more=["ids"])


STAGES = [
    ("language", with_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontamination", without_leaks),
    ("bpe", tokenised),
]

#: The first stage is a trained model: SQL cannot express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
