"""Per-dimension int8 quantisation of vectors, exact to the rounding rule (half away from zero)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def round_half_away(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x + 0.5)).otherwise(-F.floor(-x + 0.5))


def fit(rows: DataFrame) -> DataFrame:
    """One row (mu, s): the mean of each dimension and its largest distance from it (1 where that is 0).

    Each task adds up its vectors and sends a row per dimension.
    """
    import numpy as np
    import pyarrow as pa

    def matrices(batches):
        for b in batches:
            v = b.column("v")
            v = v.filter(v.is_valid())
            if len(v):
                yield np.asarray(v.flatten(), np.float64).reshape(len(v), -1)

    def sums(batches):
        total, n = 0.0, 0
        for m in matrices(batches):
            total, n = total + m.sum(0), n + len(m)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), n))], ["d", "x", "n"])

    found = rows.select("v").mapInArrow(sums, "d long, x double, n long").groupBy("d").agg((F.sum("x") / F.sum("n")).alias("mu"))
    means = np.array([r["mu"] for r in found.select("d", F.round("mu", 12).alias("mu")).orderBy("d").collect()])  # a row per dimension

    def far(batches):
        most = None
        for m in matrices(batches):
            here = np.abs(m - means).max(0)
            most = here if most is None else np.maximum(most, here)
        if most is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(most))), pa.array(means), pa.array(most)], ["d", "mu", "s"])

    widest = rows.select("v").mapInArrow(far, "d long, mu double, s double").groupBy("d").agg(F.first("mu").alias("mu"), F.max("s").alias("s"))
    ordered = F.array_sort(F.collect_list(F.struct("d", "mu", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")).alias("s"))))
    return widest.agg(ordered.alias("q")).select(F.col("q.mu").alias("mu"), F.col("q.s").alias("s"))


def codes(v: Column, mu: Column, s: Column) -> Column:
    """Between -127 and 127."""

    def one(x: Column) -> Column:
        value = round_half_away((x["v"].cast("double") - x["mu"]) / x["s"] * 127)
        return F.greatest(F.lit(-127), F.least(F.lit(127), value)).cast("tinyint")

    return F.transform(F.arrays_zip(v.alias("v"), mu.alias("mu"), s.alias("s")), one)


def restored(code: Column, mu: Column, s: Column) -> Column:
    return F.transform(F.arrays_zip(code.alias("c"), mu.alias("mu"), s.alias("s")), lambda x: x["mu"] + x["c"] * x["s"] / 127)


def folded(query: Column, s: Column) -> Column:
    """The query with the scales multiplied in; the constant term ranks nothing and is dropped."""
    return F.zip_with(query, s, lambda a, b: a.cast("double") * b / 127)
