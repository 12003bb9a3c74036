"""Mixing sources to target weights by a time-varying curriculum (operator 5); DataFrame functions only.

Targets.  With the sources in code-point order (null last) and the weights
repeating over them, a source's target is ``min(cap * size, level * weight)``,
where ``level`` makes the targets add up to ``share`` of all sizes.  Sources are
sorted by the level at which they reach their cap, so one pass of running sums
over the source table (a row per source) finds it.

Demand.  Over the training run t in [0, 1] a source is drawn at the rate
``target * (1 + ramp * (2t - 1))``: a positive ramp comes late, a negative one
early.  Its integral is the source's cumulative demand
``target * (t + ramp * (t*t - t))``, and inverting that at the word where a
document's draw begins gives the document's training position.

Documents stand in a source by the MD5 of their id and text.  Their running
sizes come from sums per (source, hash bucket) and running sums within a bucket,
so a source of a third of all rows is spread over all buckets.  Every document
is taken ``floor(target / size of the source)`` times, and those at the front
once more, the last of them in part, until the target is met to the word.

Null texts have size 0 and are taken 0 words; null sources are a source, the
last; repeated rows each count; no rows give no rows.  Very long texts are only
counted and hashed.  Rows that tie in id and text stand next to each other, in any
order, which changes no sum.  Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkshelf.session import cut

WEIGHTS, SHARE, CAP = (3, 1, 2), (3, 2), 2
RAMPS = (-0.5, 0.0, 0.5)


def words(text: str | Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _by_rank(rank: Column, values: tuple) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP, ramps: tuple = RAMPS) -> DataFrame:
    """The rows, one per source (source, source_size), with weight, ramp and target."""
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("_rank", F.row_number().over(everything.orderBy(F.col("source").isNull(), "source")))
    ranked = ranked.withColumn("weight", _by_rank(F.col("_rank"), weights).cast("long")).withColumn("ramp", _by_rank(F.col("_rank"), ramps).cast("double"))
    # source k (in order of cap / weight) is below its cap at the level that k and all later ones would share
    order = everything.orderBy(F.col("source_size") / F.col("weight"), "_rank")
    capped = F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * cap
    later = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    demand = F.sum("source_size").over(everything) * share[0] / F.lit(float(share[1]))
    level = ranked.withColumn("_level", (demand - capped) / later)
    level = level.withColumn("_level", F.max(F.when(F.col("_level") * F.col("weight") <= F.col("source_size") * cap, F.col("_level"))).over(everything))
    full = F.col("source_size") * F.lit(float(cap))
    target = F.when(F.col("_level").isNull(), full).otherwise(F.least(full, F.col("_level") * F.col("weight")))
    return level.select(*sizes.columns, "weight", "ramp", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP, ramps: tuple = RAMPS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, positions (one per draw) of every row, in order of the first position.

    ``keep``: further columns of ``docs`` to carry, as ``_keep`` (a struct); rows are not sorted then.
    """
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        words(F.col(text_col)).alias("size"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("_key"),
        F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))).alias("_at"),
        *([F.struct(*keep).alias("_keep")] if keep else []),
    )
    # narrow rows are kept, so that the texts are read once; where columns are to be carried, they are read again
    rows = rows if keep else cut(rows)
    # buckets follow the order of the hashes
    rows = rows.withColumn("_bucket", F.floor(F.conv(F.substring("_at", 1, 8), 16, 10).cast("long") * buckets / F.lit(float(1 << 32))).cast("int"))
    cells = rows.groupBy("_key", "_bucket").agg(F.sum("size").alias("_size"), F.first("source").alias("source"))
    plan = targets(cells.groupBy("_key").agg(F.sum("_size").alias("source_size"), F.first("source").alias("source")), weights, share, cap, ramps)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_size").over(Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cells = cells.select("_key", "_bucket", "_before").join(plan.drop("source"), "_key")
    within = Window.partitionBy("_key", "_bucket").orderBy("_at", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(cells, ["_key", "_bucket"]).withColumn("_start", F.col("_before") + F.col("_within"))
    placed = placed.withColumn("_epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    extra = F.floor(F.col("target")).cast("long") - F.col("_epochs") * F.col("source_size") - F.col("_start")
    placed = placed.withColumn("_part", F.greatest(F.lit(0), F.least(F.col("size"), extra)))
    taken = F.col("_epochs") * F.col("size") + F.col("_part")

    def position(epoch: Column) -> Column:
        u = F.try_divide(F.col("_start") + epoch * F.col("source_size"), F.col("target"))
        a = 1 - F.col("ramp")
        return F.least(F.lit(1.0), F.coalesce(F.try_divide(2 * u, a + F.sqrt(a * a + 4 * F.col("ramp") * u)), F.lit(0.0)))

    draws = F.when(F.col("size") > 0, F.col("_epochs")).otherwise(F.lit(0)) + (F.col("_part") > 0).cast("long")
    positions = F.when(draws > 0, F.transform(F.sequence(F.lit(0).cast("long"), draws - 1), position)).otherwise(F.array().cast("array<double>"))
    out = placed.select("doc_id", "size", "source", "source_size", "target", taken.alias("taken"), positions.alias("positions"), F.col("_part").alias("part"), *(["_keep"] if keep else []))
    if keep:  # with the columns carried along, one sort by draw is enough
        return out
    return out.orderBy(F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0)), "source", "doc_id")


def mixed_documents(docs: DataFrame, columns: tuple[str, ...], **options) -> DataFrame:
    """The documents of the mix in training order, a row per draw; a part of a document counts if it is at least half."""
    drawn = mix(docs, keep=columns, **options)
    whole = F.when(F.col("part") * 2 < F.col("size"), F.when(F.col("part") > 0, F.slice("positions", 1, F.size("positions") - 1)).otherwise(F.col("positions"))).otherwise(F.col("positions"))
    return drawn.select("_keep.*", F.explode(whole).alias("_position")).orderBy("_position").select(*columns)


#: The same as ``mix`` with its defaults, for DuckDB.
MIX_SQL = r"""
WITH sizes AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS r FROM per_source),
weighed AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM ranked),
levels AS (SELECT *, (CAST((sum(source_size) OVER ()) * 3 AS DOUBLE) / 2
    - CAST(coalesce(sum(source_size) OVER (ORDER BY source_size / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2 AS DOUBLE))
    / CAST(sum(w) OVER (ORDER BY source_size / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lv FROM weighed),
level AS (SELECT max(lv) AS lv FROM levels WHERE lv * w <= source_size * 2),
plan AS (SELECT r, source, source_size, CASE WHEN level.lv IS NULL THEN source_size * 2.0::DOUBLE ELSE least(source_size * 2.0::DOUBLE, level.lv * w) END AS target FROM weighed, level),
placed AS (SELECT s.*, p.source_size, p.target, [-0.5::DOUBLE, 0.0, 0.5][CAST((p.r - 1) % 3 + 1 AS BIGINT)] AS ramp,
    CASE WHEN p.source_size > 0 THEN CAST(floor(p.target / p.source_size) AS BIGINT) ELSE 0 END AS epochs,
    CAST(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
    FROM sizes s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
parts AS (SELECT *, greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - start)) AS part FROM placed)
SELECT doc_id, size, source_size, target, CAST(epochs * size + part AS BIGINT) AS taken,
    CASE WHEN size > 0 AND (epochs > 0 OR part > 0) THEN
        round(least(1.0::DOUBLE, 2 * (start / target) / ((1 - ramp) + sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * (start / target)))), 9) END AS position
FROM parts
"""
