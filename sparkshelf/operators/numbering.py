"""Places of rows in a total order, and quantiles, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkshelf.session import cut

_WITHIN = (1 << 33) - 1  # of monotonically_increasing_id


def numbered(df: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """The rows with their place, from 0, in the order of the columns; ranges are sorted in parallel, and a count per range comes to the driver."""
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    at = ranged.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33).cast("int")
    before = _before(at.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    return at.withColumn(name, before[part] + F.col("_at").bitwiseAND(F.lit(_WITHIN))).drop("_at")


def _before(rows: list) -> Column:
    """Range to the sum of ``n`` of all ranges before it."""
    pairs, total = [F.lit(-1), F.lit(0).cast("long")], 0
    for r in sorted(rows, key=lambda r: r["p"]):
        pairs += [F.lit(r["p"]), F.lit(total).cast("long")]
        total += r["n"]
    return F.create_map(*pairs)


def quantiles(df: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row: the elements at floor(n * share) of the sorted values.

    Equal values are counted first and their counts sorted in ranges; a sum per range
    tells in which one an element lies, and running sums go over single ranges.
    """
    spark = df.sparkSession
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    ranged = cut(counts.repartitionByRange("x").sortWithinPartitions("x")).withColumn("_p", F.spark_partition_id())
    rows = ranged.groupBy(F.col("_p").alias("p")).agg(F.sum("c").alias("n")).collect()
    total = sum(r["n"] for r in rows)
    if not total:
        kind = counts.schema["x"].dataType.simpleString()
        return spark.range(1).select(*[F.lit(None).cast(kind).alias(n) for n in shares])
    upto = F.sum("c").over(Window.partitionBy("_p").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)) + _before(rows)[F.col("_p")]
    wanted, start = {n: min(int(total * s), total - 1) for n, s in shares.items()}, 0
    held = set()
    for r in sorted(rows, key=lambda r: r["p"]):
        held |= {r["p"]} if any(start <= w < start + r["n"] for w in wanted.values()) else set()
        start += r["n"]
    placed = ranged.where(F.col("_p").isin(*held)).withColumn("upto", upto)
    return placed.agg(*[F.min(F.when(F.col("upto") > w, F.col("x"))).alias(n) for n, w in wanted.items()])
