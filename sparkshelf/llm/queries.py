"""The ten registered queries over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkshelf.llm import archive, fingerprints, licenses, mixing, near_copies, packing, quality, secrets, token_counts, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_documents(spark, sf_dir))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copies(_documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round(F.get("positions", F.lit(0)), 9).alias("position"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.order_minhash(_documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_rules, op2_secret_scans, op3_best_fit_packing, op4_near_dedup, op5_mixing, op6_license_scans, op7_toxicity, op8_warc_archive, op9_fingerprints, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op4_near_dedup": near_copies.NEAR_SQL, "op5_mixing": mixing.MIX_SQL, "op8_warc_archive": archive.ARCHIVE_SQL}
