"""Line scans: foreign scripts and control characters, and a catalogue of secret patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkshelf.functions.text import violations
from sparkshelf.operators.chunks import line_chunks

#: rule, level (block or warn), regex.
SECRETS = (
    ("private_key", "block", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("cloud_key", "block", "AKIA[0-9A-Z]{16}"),
    ("assigned", "block", "(?i)(api[_-]?key|secret|token|password|passwd) *[:=] *[^ ]{12,}"),
    ("eval_call", "warn", "(^|[^A-Za-z_])eval ?[(]"),
)


def hygiene(docs: DataFrame) -> DataFrame:
    """Lines and documents by kind of violation."""
    found = line_chunks(docs).select("doc_id", F.explode(violations(F.col("text"))).alias("kind"))
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("doc_id").alias("docs"))


def secret_catalogue(docs: DataFrame, rules=SECRETS) -> DataFrame:
    """Lines and documents by rule, all rules in one pass over the lines."""
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(regex), F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("level"))) for rule, level, regex in rules]))
    found = line_chunks(docs).select("doc_id", F.explode(hits).alias("h"))
    return found.groupBy("h.rule", "h.level").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("doc_id").alias("docs"))
