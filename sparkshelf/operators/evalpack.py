"""Stored rankings, a row per item, from which metrics are computed again without ranking again.

A pack is a table of (item, grp, gold, excluded, and an array of ids in rank order
for each method).  All of an item stands in its row, so metrics for other cuts,
fusion constants, methods or groups take one scan and an aggregate; query texts
are not in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkshelf.operators.ranking import POOL, RRF_K

HYBRID = "hybrid"


def pack(rankings: DataFrame, gold: DataFrame, items: DataFrame, methods: tuple[str, ...], excluded: DataFrame | None = None, pool: int = POOL) -> DataFrame:
    """``rankings``: method, item, id, rank; ``gold`` and ``excluded``: item, id; ``items``: item, grp."""
    ranked = rankings.where(F.col("rank") <= pool).groupBy("item").pivot("method", list(methods)).agg(F.array_sort(F.collect_list(F.struct("rank", "id"))))
    ranked = ranked.select("item", *[F.transform(F.col(m), lambda x: x["id"]).alias(m) for m in methods])
    lists = lambda df, name: df.groupBy("item").agg(F.array_sort(F.collect_set("id")).alias(name))
    out = items.select("item", "grp").join(lists(gold, "gold"), "item", "left").join(ranked, "item", "left")
    out = out.join(lists(excluded, "excluded"), "item", "left") if excluded is not None else out.withColumn("excluded", F.lit(None).cast("array<long>"))
    return out.select("item", "grp", *[F.coalesce(c, F.array().cast("array<long>")).alias(c) for c in ("gold", "excluded", *methods)])


def store(packed: DataFrame, path: str) -> None:
    packed.write.parquet(path)


def load(spark: SparkSession, path: str, methods: tuple[str, ...], pool: int = POOL) -> DataFrame:
    """A stored pack; one with an item twice, a list longer than ``pool`` or an id twice in a list raises."""
    found = spark.read.parquet(path)
    wrong = F.lit(False)
    for m in methods:
        wrong = wrong | (F.size(m) > pool) | (F.size(F.array_distinct(m)) != F.size(m))
    bad = found.agg(F.count_if(wrong).alias("lists"), (F.count(F.lit(1)) - F.count_distinct("item")).alias("items")).first()
    if bad.lists or bad.items:
        raise ValueError(f"not a pack: {bad.lists} items with wrong lists, {bad.items} items too many")
    return found


def fused(lists: list[Column], rrf_k: int | Column = RRF_K, pool: int = POOL) -> Column:
    """Reciprocal rank fusion within a row: the ids of all lists by falling sums, equal sums by id, cut at ``pool``."""
    k = rrf_k if isinstance(rrf_k, Column) else F.lit(rrf_k)

    def score(x: Column) -> Column:
        total = F.lit(0.0)
        for ids in lists:
            place = F.array_position(ids, x)
            total = total + F.when(place > 0, 1 / (k + place)).otherwise(0.0)
        return F.struct((-F.round(total, 12)).alias("score"), x.alias("id"))

    every = F.array_distinct(F.flatten(F.array(*lists)))
    return F.slice(F.transform(F.array_sort(F.transform(every, score)), lambda x: x["id"]), 1, pool)


def _measured(ranking: Column, gold: Column, k: int) -> Column:
    """recall, hit, rr, ndcg of one row; without gold all are 0."""
    hits = F.filter(F.transform(ranking, lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda i: i.isNotNull())
    near = F.filter(hits, lambda i: i <= k)
    gain = lambda a: F.aggregate(a, F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    ideal = gain(F.sequence(F.lit(1), F.least(F.size(gold), F.lit(k))))
    some = F.size(gold) > 0
    return F.struct(
        F.when(some, F.size(near) / F.size(gold)).otherwise(0.0).alias("recall"), (F.size(near) > 0).cast("double").alias("hit"),
        F.coalesce(1 / F.get(hits, F.lit(0)), F.lit(0.0)).alias("rr"), F.when(some, gain(near) / ideal).otherwise(0.0).alias("ndcg"),
    )


def per_item(packed: DataFrame, methods: tuple[str, ...], k: int = 10, rrf_k: int = RRF_K, group=None, only: str | None = None) -> DataFrame:
    """item, grp, method, recall, hit, rr, ndcg; ``group``: items of that group alone; ``only``: one method (``hybrid`` fuses all)."""
    rows = packed if group is None else packed.where(F.col("grp") == F.lit(group))
    wanted = (*methods, HYBRID) if only is None else (only,)
    ranking = {m: F.col(m) for m in methods} | {HYBRID: fused([F.col(m) for m in methods], rrf_k)}
    made = F.array(*[F.struct(F.lit(m).alias("method"), _measured(ranking[m], F.col("gold"), k).alias("x")) for m in wanted])
    return rows.select("item", "grp", F.explode(made).alias("m")).select("item", "grp", "m.method", "m.x.*")


def metrics(packed: DataFrame, methods: tuple[str, ...], k: int = 10, rrf_k: int = RRF_K, group=None, only: str | None = None) -> DataFrame:
    """method, n, recall, hit, mrr, ndcg as means over the items."""
    return per_item(packed, methods, k, rrf_k, group, only).groupBy("method").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 9).alias("mrr" if c == "rr" else c) for c in ("recall", "hit", "rr", "ndcg")])


def by_group(packed: DataFrame, methods: tuple[str, ...], k: int = 10, rrf_k: int = RRF_K, least: int = 30) -> DataFrame:
    """grp, n, each method's recall, hybrid, loses (fusion is below the best single method) and gap, for groups of ``least`` items or more, the smallest gap first."""
    rows = per_item(packed, methods, k, rrf_k).groupBy("grp").agg((F.count(F.lit(1)) / (len(methods) + 1)).cast("long").alias("n"), *[F.round(F.avg(F.when(F.col("method") == m, F.col("recall"))), 9).alias(m) for m in (*methods, HYBRID)])
    gap = F.round(F.col(HYBRID) - F.greatest(*methods), 9)
    return rows.where(F.col("n") >= least).select("grp", "n", *methods, HYBRID, (F.col(HYBRID) < F.greatest(*methods)).alias("loses"), gap.alias("gap")).orderBy("gap", "grp")


def first_hits(packed: DataFrame, methods: tuple[str, ...], every: int = 47, most: int = 12, group=None, rrf_k: int = RRF_K) -> DataFrame:
    """Examples: every n-th item, ``most`` at most, with each method's first rank that hits, -1 for none; the number is the feature."""
    rows = packed if group is None else packed.where(F.col("grp") == F.lit(group))
    rows = rows.where(F.col("item") % every == 0).orderBy("item").limit(most)
    ranking = {m: rows[m] for m in methods} | {HYBRID: fused([rows[m] for m in methods], rrf_k)}
    first = lambda r: F.coalesce(F.array_min(F.filter(F.transform(r, lambda x, i: F.when(F.array_contains(rows["gold"], x), i + 1)), lambda i: i.isNotNull())), F.lit(-1)).cast("long")
    return rows.select("item", *[first(r).alias(m) for m, r in ranking.items()])
