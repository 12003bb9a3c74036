"""Writers with the checks that belong to them, and size reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Parquet, and its number of rows; an empty table is an error."""
    df.write.mode(mode).parquet(path)
    n = df.sparkSession.read.parquet(path).count()
    if not n:
        raise ValueError(f"no rows were written to {path}")
    return n


def write_vectors(df: DataFrame, path: str, dims: int) -> int:
    """Vectors (id, v); any other number of dimensions is an error."""
    right = F.assert_true(F.size("v") == dims, F.lit(f"a vector has not {dims} dimensions"))
    n = write_table(df.where(right.isNull()), path)
    held = df.sparkSession.read.parquet(path).agg(F.sum(F.size("v")).alias("n")).first()["n"]
    if held != n * dims:
        raise ValueError(f"{held} numbers were written for {n} vectors of {dims}")
    return n


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All columns of all frames in the order in which they first appear; missing values are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_csv(frames: list[DataFrame], path: str) -> None:
    """With header and, at the start of each file, a byte-order mark."""
    df = union_all(frames)
    first = f"﻿{df.columns[0]}"
    df.withColumnRenamed(df.columns[0], first).write.option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A long table of figures as JSON lines."""
    df.write.json(path)


def review_sheet(items: DataFrame, path: str, columns: tuple[str, ...]) -> None:
    """Items as a Markdown list; meant for a sample."""
    text = F.concat(F.lit("- "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]))
    items.select(text.alias("value")).write.text(path)


def sizes(spark: SparkSession, path: str, stages: dict[str, str], gzipped: bool = False) -> DataFrame:
    """Bytes of the files under ``path`` by stage; ``stages``: stage -> regex on the file's path; ``gzipped``: their bytes after gzip too."""
    import gzip

    import pyarrow as pa

    def packed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("length"), pa.array([len(gzip.compress(x.as_py())) for x in b.column("content")], pa.int64())], ["path", "length", "gz"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files.select("path", "length", "content").mapInArrow(packed, "path string, length long, gz long") if gzipped else files.select("path", "length")
    stage = F.coalesce(*[F.when(F.col("path").rlike(regex), F.lit(name)) for name, regex in stages.items()], F.lit("other"))
    return files.groupBy(stage.alias("stage")).agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files"), *([F.sum("gz").alias("gzip_bytes")] if gzipped else []))


def write_codes(coded: DataFrame, fitted: DataFrame, path: str) -> int:
    """Quantised vectors (id, c) and the quantiser (mu, s) beside them; an empty table is an error."""
    n = write_table(coded.select("id", "c"), f"{path}/codes")
    write_table(fitted, f"{path}/quantiser")
    return n


def write_ranking(ranking: DataFrame, path: str) -> None:
    """item, id, rank and score as JSON lines, for checks against another implementation."""
    ranking.select("item", "id", "rank", "score").write.json(path)
