"""Files that are neither tables nor statutes: text trees, lists of queries, flat float matrices, diffs; and what is still to be fetched."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Endings of text files, and folders that are never looked into; both can be given otherwise.
SUFFIXES = ("md", "txt", "json", "py", "ts", "tsx", "mjs", "js", "css", "html", "yml", "yaml", "toml")
SKIPPED = ("node_modules", ".git", "dist", "build", ".next", "out")


def read_tree(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES, ignores: tuple[str, ...] = (), skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """file (relative to ``root``), text of every text file below it, but those in skipped folders or with an ignored piece of path."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*.{{{','.join(suffixes)}}}")
    top = root.split(":", 1)[-1].strip("/")
    file = F.regexp_replace(F.element_at(F.split(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), f"\\Q{top}/\\E", 2), 2), "^/+", "")
    found = files.select(file.alias("file"), F.col("value").alias("text"))
    folders = F.slice(F.split("file", "/"), 1, F.greatest(F.size(F.split("file", "/")) - 1, F.lit(0)))
    keep = ~F.arrays_overlap(folders, F.array(*[F.lit(s) for s in skipped])) if skipped else F.lit(True)
    for piece in ignores:
        keep = keep & ~F.contains("file", F.lit(piece))
    return found.where(keep)


def read_ignores(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Lines of a small settings file, without blank ones and comments."""
    lines = spark.read.text(path).select(F.trim("value").alias("x")).where("x != '' AND NOT startswith(x, '#')")
    return tuple(r.x for r in lines.collect())


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """id, query of query files: objects with ``items`` of (id, query), or bare lists of texts, whose ids are their places (``neg-0`` and so on)."""
    raw = spark.read.text(path, wholetext=True)
    whole = raw.where(F.ltrim("value").startswith("{")).select(F.explode(F.from_json("value", "items array<struct<id:string,query:string>>")["items"]).alias("x")).select("x.id", "x.query")
    bare = raw.where(F.ltrim("value").startswith("[")).select(F.posexplode(F.from_json("value", "array<string>")).alias("p", "query")).select(F.concat(F.lit("neg-"), "p").alias("id"), "query")
    return whole.unionByName(bare)


def read_matrix(spark: SparkSession, path: str, dims: int, expect: int | None = None) -> DataFrame:
    """id (row number), v of a flat file of little-endian float32; bytes that are no whole rows raise, and so does another number of rows than expected.

    A file is one matrix and is read whole by one task.
    """

    def work(batches):
        for b in batches:
            for blob in b.column("content"):
                flat = np.frombuffer(blob.as_py(), "<f4")
                if len(flat) % dims or (expect is not None and len(flat) != expect * dims):
                    raise ValueError(f"{len(flat)} numbers are not {'whole' if expect is None else expect} rows of {dims}")
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat) // dims)), pa.array(flat.reshape(-1, dims).tolist(), pa.list_(pa.float32()))], ["id", "v"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(work, "id long, v array<float>")


def landing(wanted: DataFrame, landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is still to be fetched (id), and the manifest: requested, skipped (there already) and to fetch."""
    asked = wanted.select("id").distinct()
    there = landed.select("id").distinct().withColumn("_there", F.lit(True))
    both = asked.join(there, "id", "left")
    manifest = both.agg(F.count(F.lit(1)).alias("requested"), F.count("_there").alias("skipped"), F.count_if(F.col("_there").isNull()).alias("to_fetch"))
    return both.where("_there IS NULL").select("id"), manifest


def added_lines(diff: DataFrame) -> DataFrame:
    """file, line, text of the lines that unified diffs add; ``diff``: name, p (place from 0), value, a row per line of a diff."""
    order = Window.partitionBy("name").orderBy("p")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    header = F.col("value").startswith("+++ ")
    added = F.col("value").startswith("+") & ~F.col("value").startswith("+++")
    hunk = F.regexp_extract("value", r"^@@.*?\+(\d+)", 1).try_cast("long")
    rows = diff.select("*", F.last(F.when(header, F.regexp_replace("value", "^\\+\\+\\+ b/", "")), True).over(upto).alias("file"), F.last(F.when(F.col("value").startswith("@@"), hunk), True).over(upto).alias("_from"), F.sum(F.col("value").startswith("@@").cast("int")).over(upto).alias("_hunk"), added.alias("_added"))
    within = Window.partitionBy("name", "_hunk").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("line", F.col("_from") + F.sum(F.col("_added").cast("int")).over(within) - 1).where("_added").select("file", "line", F.substring("value", 2, 1 << 30).alias("text"))
