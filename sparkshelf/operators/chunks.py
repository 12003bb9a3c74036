"""Chunks of documents at two granularities, and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkshelf.operators.metrics import quantiles

GAP = "　"


def document_chunks(docs: DataFrame) -> DataFrame:
    """A chunk per document; the language stands in for a caption and precedes the text that is indexed.  Empty ones are left out."""
    return docs.where(F.length("text") > 0).select(
        F.concat_ws("", "source", F.lit("#"), F.col("doc_id").cast("string"), F.lit("-0")).alias("id"), "doc_id", "source", "text", F.concat(F.coalesce(F.concat("lang", F.lit(GAP)), F.lit("")), F.col("text")).alias("index_text")
    )


def line_chunks(docs: DataFrame) -> DataFrame:
    """A chunk per line that is not empty; lines are numbered from 1 with the empty ones."""
    lines = docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n", -1)).alias("p", "text")).where(F.length("text") > 0)
    line = (F.col("p") + 1).cast("long")
    return lines.select(F.concat_ws("", "source", F.lit("#"), F.col("doc_id").cast("string"), F.lit("-"), line.cast("string")).alias("id"), "doc_id", "lang", "source", line.alias("line"), "text")


def merged(chunks: DataFrame) -> DataFrame:
    """Parents put together again from their parts, in the parts' order."""
    parts = F.array_sort(F.collect_list(F.struct("line", "text")))
    return chunks.groupBy("doc_id", "source").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))


def stats_by_source(chunks: DataFrame) -> DataFrame:
    """Chunks, documents and characters of each source, and of all (null)."""
    return chunks.rollup("source").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("doc_id").alias("docs"), F.sum(F.length("text")).alias("chars"))


def length_stats(chunks: DataFrame) -> DataFrame:
    return quantiles(chunks.select(F.length("text").cast("long").alias("n")), "n", {"min": 0.0, "p50": 0.5, "p90": 0.9, "max": 1.0})
