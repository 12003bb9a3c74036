"""A corpus pipeline: quality rules, near-dedup, secret redaction, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before
kept, and returns a DataFrame; all but the last return the columns of
``documents``.  ``run`` writes each stage's result as Parquet in the shared
checkpoint folder and reads it again for the next.  Empty tables pass through;
null texts fail the quality rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkshelf.llm import mixing, near_copies, packing, quality, secrets
from sparkshelf.session import scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SHINGLE_WORDS = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rule or are outliers of their language and source."""
    return quality.kept_documents(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies, by shingles of five words (operator 4 by itself takes two)."""
    return near_copies.without_near_copies(docs.select(*COLUMNS), width=SHINGLE_WORDS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets; every document stays."""
    return secrets.redact(docs.select(*COLUMNS))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, in training order."""
    return mixing.mixed_documents(docs, COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, a row per piece."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("secret scans", secret_scans),
    ("mixing sources", mixing_sources),
    ("best-fit packing", best_fit_packing),
]

#: Robust estimates, register bands, trigram queries and packing are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
