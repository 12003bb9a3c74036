"""Queries on sparse, dense, quantised and fused rankings, their metrics, sweeps and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkshelf.functions import text as T
from sparkshelf.operators import evalpack, metrics, quantise, ranking, sparse_blocks
from sparkshelf.operators.numbering import numbered
from sparkshelf.plans.text import BIGRAMS, INDEX, SEGMENTS
from sparkshelf.session import cut, scratch, table

#: Constants of the sweep; fixed values.
SWEEP = (1, 5, 10, 20, 60, 200, 1000)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), "text")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _sparse(spark: SparkSession, sf_dir: str, k: int = ranking.POOL) -> DataFrame:
    return sparse_blocks.rank(_docs(spark, sf_dir), _items(spark, sf_dir), k)


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain an item's text: the items, a stated query set, against all rows."""
    return ranking.containing(_docs(spark, sf_dir), _items(spark, sf_dir))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _vector_queries(rows: DataFrame) -> DataFrame:
    """The stated query set: every id that 20 divides."""
    return rows.where("id % 20 = 0").select(F.col("id").alias("item"), "v", F.col("label").alias("item_label"))


def bm25_topk(spark, sf_dir):
    return _sparse(spark, sf_dir, 10).select("item", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


def bm25_topk_exclude(spark, sf_dir):
    gold = _gold(spark, sf_dir)
    found = sparse_blocks.rank(_docs(spark, sf_dir), _items(spark, sf_dir), 10, exclude=gold)
    return found.select("item", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


def bm25_self_control(spark, sf_dir):
    """Items whose text is a document's, or a part of it, found among the first ten."""
    found = _sparse(spark, sf_dir, 10)
    gold = _gold(spark, sf_dir)
    firsts = found.join(gold, ["item", "id"]).groupBy("item").agg(F.min("rank").alias("rank"))
    have = gold.select("item").distinct().join(firsts, "item", "left")
    return have.agg(F.count(F.lit(1)).alias("tried"), F.coalesce(F.sum((F.col("rank") == 1).cast("long")), F.lit(0)).alias("first"), F.coalesce(F.sum(F.col("rank").isNotNull().cast("long")), F.lit(0)).alias("found"))


def dense_topk(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return ranking.dense(rows, _vector_queries(rows), 10).select("item", "id", "score", F.col("rank").cast("long").alias("rank"))


def vector_norms(spark, sf_dir):
    n = _vectors(spark, sf_dir).select(ranking.norm(F.col("v")).alias("n"))
    return n.agg(F.round(F.min("n"), 9).alias("min_norm"), F.round(F.max("n"), 9).alias("max_norm"), F.count_if(F.col("n") == 0).alias("zero_rows"), F.count(F.lit(1)).alias("rows"))


def _label_gold(rows: DataFrame) -> DataFrame:
    """Rows of the query's own label, without itself."""
    q = _vector_queries(rows).select("item", "item_label")
    return rows.select("id", "label").join(ranking.small(q), F.col("label") == F.col("item_label")).where("id != item").select("item", "id")


def dense_label_recall(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    q = _vector_queries(rows)
    found = ranking.dense(rows, q, ranking.POOL)
    return metrics.means(metrics.per_item(found, _label_gold(rows), q.select("item", "item_label")), F.col("item_label").cast("long").alias("label"))


def quant_fit(spark, sf_dir):
    fitted = quantise.fit(_vectors(spark, sf_dir))
    return fitted.select(F.posexplode(F.arrays_zip("mu", "s")).alias("d", "q")).select(F.col("d").cast("long").alias("d"), F.round("q.mu", 9).alias("mu"), F.round("q.s", 9).alias("s"))


def _coded(rows: DataFrame) -> DataFrame:
    return rows.crossJoin(F.broadcast(quantise.fit(rows))).withColumn("c", quantise.codes(F.col("v"), F.col("mu"), F.col("s")))


def quant_codes(spark, sf_dir):
    return _coded(_vectors(spark, sf_dir)).select("id", F.md5(F.array_join(F.transform("c", lambda x: x.cast("string")), ",")).alias("digest"))


def _quant_ranking(rows: DataFrame, k: int) -> DataFrame:
    coded = _coded(rows)
    q = coded.where("id % 20 = 0").select(F.col("id").alias("item"), quantise.folded(F.col("v"), F.col("s")).alias("v"))
    return ranking.dense(coded.select("id", F.transform("c", lambda x: x.cast("double")).alias("v")), q, k)


def quant_topk(spark, sf_dir):
    return _quant_ranking(_vectors(spark, sf_dir), 10).select("item", "id", "score", F.col("rank").cast("long").alias("rank"))


def quant_agreement(spark, sf_dir):
    """How well quantised rankings keep the exact ones' first ten."""
    rows = _vectors(spark, sf_dir)
    exact = ranking.dense(rows, _vector_queries(rows), 10).select("item", "id", F.col("rank").alias("ra"))
    coded = _quant_ranking(rows, 10).select("item", "id", F.col("rank").alias("rb"))
    both = exact.join(coded, ["item", "id"], "full").groupBy("item").agg(F.count_if(F.col("ra").isNotNull() & F.col("rb").isNotNull()).alias("shared"), F.count("ra").alias("k"), F.max((F.col("ra") == 1) & F.coalesce(F.col("rb") == 1, F.lit(False))).alias("top"))
    return both.agg(F.round(F.avg((F.col("shared") == F.col("k")).cast("double")), 9).alias("set_agreement"), F.round(F.avg(F.col("shared") / F.col("k")), 9).alias("overlap"), F.round(F.avg(F.col("top").cast("double")), 9).alias("top1"), F.count(F.lit(1)).alias("n"))


def quant_flat_control(spark, sf_dir):
    """One scale for all dimensions: its step, and the mean error of it and of the fitted scales."""
    rows = _vectors(spark, sf_dir)
    flat = rows.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("m"))
    coded = _coded(rows).crossJoin(F.broadcast(flat))
    far = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)
    flat_back = F.transform("v", lambda x: quantise.round_half_away(x.cast("double") / F.col("m") * 127) * F.col("m") / 127)
    errors = coded.select("m", far(F.col("v"), quantise.restored(F.col("c"), F.col("mu"), F.col("s"))).alias("fitted"), far(F.col("v"), flat_back).alias("flat"))
    return errors.agg(F.round(F.max("m"), 9).alias("abs_max"), F.round(F.avg("fitted"), 8).alias("fitted_error"), F.round(F.avg("flat"), 8).alias("flat_error"))


def _rankings(spark, sf_dir) -> DataFrame:
    """Two rankings of documents for the items: BM25, and bigram overlap by the share of the item's bigrams."""
    return cut(sparse_blocks.rank_by(_docs(spark, sf_dir), _items(spark, sf_dir)).select("method", "item", "id", "rank"))


def _fused(both: DataFrame) -> DataFrame:
    return ranking.fuse(both).select(F.lit("hybrid").alias("method"), "item", "id", "rank")


def rrf_fuse(spark, sf_dir):
    return ranking.fuse(_rankings(spark, sf_dir)).select("item", "id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


def _methods(spark) -> DataFrame:
    return spark.createDataFrame([("bm25",), ("overlap",), ("hybrid",)], "method string")


def metrics_overall(spark, sf_dir):
    both = _rankings(spark, sf_dir)
    items = _items(spark, sf_dir).select("item").crossJoin(F.broadcast(_methods(spark)))
    return metrics.means(metrics.per_item(both.unionByName(_fused(both)), _gold(spark, sf_dir), items, ("method",)), "method")


def metrics_by_group(spark, sf_dir):
    """By method, and by method and group (the item's id modulo 4) in one pass; loses: fusion is below the better single method."""
    both = _rankings(spark, sf_dir)
    items = _items(spark, sf_dir).select("item", (F.col("item") % 4).alias("grp")).crossJoin(F.broadcast(_methods(spark)))
    rows = metrics.per_item(both.unionByName(_fused(both)), _gold(spark, sf_dir), items, ("method",))
    by = rows.rollup("grp").agg(*[F.round(F.avg(F.when(F.col("method") == m, F.col("recall_10"))), 9).alias(m) for m in ("bm25", "overlap", "hybrid")])
    return by.withColumn("loses", F.col("hybrid") < F.greatest("bm25", "overlap"))


def rrf_sweep(spark, sf_dir):
    """All constants in one plan over the same two rankings."""
    both = _rankings(spark, sf_dir)
    ks = spark.createDataFrame([(k,) for k in SWEEP], "k long")
    fused = ranking.fuse(both.crossJoin(F.broadcast(ks)), F.col("k"), by=("k", "item"))
    items = _items(spark, sf_dir).select("item").crossJoin(F.broadcast(ks))
    return metrics.means(metrics.per_item(fused, _gold(spark, sf_dir), items, ("k",)), "k").select("k", "n", "recall_10", "mrr")


def article_rollup(spark, sf_dir):
    """Rankings of documents rolled up to their sources."""
    parent = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("parent"))
    return ranking.roll_up(_sparse(spark, sf_dir), parent).select("item", F.col("id").alias("source"), F.col("rank").cast("long").alias("rank"))


def gate_verdicts(spark, sf_dir):
    """A row per gate: value, threshold, pass."""
    found = _sparse(spark, sf_dir)
    items = _items(spark, sf_dir).select("item")
    gold = _gold(spark, sf_dir)
    per = metrics.per_item(found, gold, items)
    able = per.join(gold.select("item").distinct(), "item", "left_semi")
    tops = items.join(found.where("rank = 1").select("item", "score"), "item", "left").join(gold.select("item").distinct().withColumn("has", F.lit(True)), "item", "left")
    value = tops.agg(F.coalesce(F.max(F.when(F.col("has").isNull(), F.col("score"))), F.lit(0.0)).alias("value"))
    middle = metrics.quantiles(tops.where("has"), "score", {"threshold": 0.5})
    rows = [
        able.agg(F.coalesce(F.avg("recall_10"), F.lit(0.0)).alias("value")).select(F.lit("sparse_recall").alias("gate"), "value", F.lit(0.5).alias("threshold"), (F.col("value") >= 0.5).alias("pass")),
        able.agg(F.coalesce(F.avg(1 - F.col("hit_10")), F.lit(0.0)).alias("value")).select(F.lit("sparse_miss").alias("gate"), "value", F.lit(0.1).alias("threshold"), (F.col("value") >= 0.1).alias("pass")),
        value.crossJoin(middle).select(F.lit("negatives_below").alias("gate"), "value", F.coalesce("threshold", F.lit(0.0)).alias("threshold"), (F.col("value") < F.coalesce("threshold", F.lit(0.0))).alias("pass")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).withColumn("value", F.round("value", 9))


def set_agreement(spark, sf_dir):
    """Of each item's first ten by two methods: shared, only in the first, only in the second, and the first rank at which they differ."""
    both = _rankings(spark, sf_dir).where("rank <= 10")
    sides = both.groupBy("item", "id").pivot("method", ["bm25", "overlap"]).agg(F.min("rank"))
    sets = sides.groupBy("item").agg(F.count_if(F.col("bm25").isNotNull() & F.col("overlap").isNotNull()).alias("shared"), F.count_if(F.col("overlap").isNull()).alias("only_bm25"), F.count_if(F.col("bm25").isNull()).alias("only_overlap"), F.min(F.when(~F.col("bm25").eqNullSafe(F.col("overlap")), F.least("bm25", "overlap"))).cast("long").alias("first_difference"))
    return sets


def stride_sample(spark, sf_dir, want: int = 100):
    """Every n-th document in id order, ``want`` at most."""
    placed = cut(numbered(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", name="idx"))
    step = max(1, placed.count() // want)
    return placed.where((F.col("idx") % step == 0) & (F.col("idx") < step * want))


def review_flags(spark, sf_dir):
    """Items with what a reviewer should look at."""
    items = _items(spark, sf_dir).join(_gold(spark, sf_dir).groupBy("item").agg(F.count(F.lit(1)).alias("g")), "item", "left")
    g = F.coalesce("g", F.lit(0))
    flags = F.array_compact(F.array(F.when(g == 0, "gold_missing"), F.when(g >= 5, "gold_many"), F.when(F.length("text") > 200, "long"), F.when(T.substantive_length("text") < 20, "bare")))
    return items.select("item", F.array_join(flags, ",").alias("flags"))


def bm25_postings(spark, sf_dir):
    """The declarative form of ``bm25_topk``: postings joined with the queries' terms."""
    from sparkshelf.operators import index

    built = index.build(table(spark, sf_dir, "documents"), "doc_id")
    return ranking.bm25(built, _items(spark, sf_dir), 10).select("item", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


_PACKS: dict[tuple[str, str], str] = {}
PAIR = ("bm25", "overlap")


def _pack(spark, sf_dir) -> DataFrame:
    """The stored pack of these tables, ranked and written once in a session; items go to groups by their id modulo 4."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PACKS:
        items = _items(spark, sf_dir).select("item", (F.col("item") % 4).alias("grp"))
        path = f"{scratch(spark)}/pack"
        evalpack.store(evalpack.pack(_rankings(spark, sf_dir), _gold(spark, sf_dir), items, PAIR), path)
        evalpack.load(spark, path, PAIR)
        _PACKS[key] = path
    return spark.read.parquet(_PACKS[key])


def rank_cache(spark, sf_dir):
    return _pack(spark, sf_dir).select("item", F.col("grp").cast("long").alias("grp"), *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("gold", *PAIR)])


def metrics_cached(spark, sf_dir):
    """Means at 10 of all methods from the stored ranks."""
    return evalpack.metrics(_pack(spark, sf_dir), PAIR)


def metrics_by_law(spark, sf_dir):
    """Recall by group from the stored ranks, for groups of at least eight items."""
    return evalpack.by_group(_pack(spark, sf_dir), PAIR, least=8).withColumn("grp", F.col("grp").cast("long"))


def metrics_of_group(spark, sf_dir):
    """One group, another cut and constant."""
    return evalpack.metrics(_pack(spark, sf_dir), PAIR, k=5, rrf_k=10, group=1)


def example_ranks(spark, sf_dir):
    return evalpack.first_hits(_pack(spark, sf_dir), PAIR, every=7, most=12)


QUERIES = [rank_cache, metrics_cached, metrics_by_law, metrics_of_group, example_ranks, bm25_topk, bm25_postings, bm25_topk_exclude, bm25_self_control, dense_topk, vector_norms, dense_label_recall, quant_fit, quant_codes, quant_topk, quant_agreement, quant_flat_control, rrf_fuse, rrf_sweep, metrics_overall, metrics_by_group, article_rollup, gate_verdicts, set_agreement, stride_sample, review_flags]

GOLD = "gold AS (SELECT b.item_id AS item, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
TERMS = f"qseg AS (SELECT item_id AS item, {SEGMENTS} AS seg FROM benchmark), terms AS (SELECT DISTINCT item, unnest({BIGRAMS}) AS term FROM qseg)"
BM25 = f"""{INDEX}, {TERMS},
sparse AS (SELECT item, p.id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score
    FROM terms JOIN postings p USING (term) JOIN dfs USING (term) JOIN lengths l ON l.id = p.id, stats GROUP BY ALL HAVING score > 0)"""
RANKED = f"""{BM25}, {GOLD},
bm AS (SELECT item, id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, id) AS rank FROM sparse QUALIFY rank <= 50),
ov AS (SELECT item, p.id, round(count(*) / sqrt(CAST(any_value(dl) AS DOUBLE)), 9) AS score FROM terms JOIN postings p USING (term) JOIN lengths l ON l.id = p.id GROUP BY ALL),
ovr AS (SELECT item, id, row_number() OVER (PARTITION BY item ORDER BY score DESC, id) AS rank FROM ov QUALIFY rank <= 50),
both_m AS (SELECT 'bm25' AS method, item, id, rank FROM bm UNION ALL SELECT 'overlap', item, id, rank FROM ovr),
fused AS (SELECT item, id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, id) AS rank FROM (SELECT item, id, round(sum(1 / (60 + rank)), 12) AS score FROM both_m GROUP BY ALL) QUALIFY rank <= 50),
allm AS (SELECT * FROM both_m UNION ALL SELECT 'hybrid', item, id, rank FROM fused)"""


def _measured(rankings: str, items: str, by: str) -> str:
    """CTEs giving per_item: metrics of ``rankings`` for each row of ``items`` (a query)."""
    return f"""sizes AS (SELECT item, count(*) AS g FROM gold GROUP BY item),
hits AS (SELECT {by} r.item, sum(CAST(rank <= 1 AS INT)) AS h1, sum(CAST(rank <= 5 AS INT)) AS h5, sum(CAST(rank <= 10 AS INT)) AS h10, sum(CAST(rank <= 20 AS INT)) AS h20, min(rank) AS first, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg
    FROM {rankings} r JOIN gold ON gold.item = r.item AND gold.id = r.id GROUP BY ALL),
per_item AS (SELECT i.*, coalesce(h1 / g, 0) AS recall_1, coalesce(h5 / g, 0) AS recall_5, coalesce(h10 / g, 0) AS recall_10, coalesce(h20 / g, 0) AS recall_20, coalesce(CAST(first <= 10 AS DOUBLE), 0) AS hit_10, coalesce(1 / first, 0) AS rr,
    coalesce(dcg / list_sum([1 / log2(k + 1) FOR k IN range(1, least(g, 10) + 1)]), 0) AS ndcg_10
    FROM ({items}) i LEFT JOIN sizes USING (item) LEFT JOIN hits USING ({by} item))"""


METHODS = "SELECT item_id AS item, method FROM benchmark, (SELECT unnest(['bm25', 'overlap', 'hybrid']) AS method)"
MEANS = ", ".join(f"round(avg({c}), 9) AS {'mrr' if c == 'rr' else c}" for c in ("recall_1", "recall_5", "recall_10", "recall_20", "hit_10", "rr", "ndcg_10"))
V = "v AS (SELECT vec_id AS id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings)"
DENSE = f"""{V}, dots AS (SELECT q.id AS item, r.id, round(list_dot_product(q.v, r.v), 9) + 0 AS score FROM v q JOIN v r ON r.id <> q.id WHERE q.id % 20 = 0),
dense AS (SELECT item, id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, id) AS rank FROM dots QUALIFY rank <= 50)"""
FIT = f"""{V}, long AS (SELECT id, unnest(v) AS x, unnest(range(len(v))) AS d FROM v), mu AS (SELECT d, round(avg(x), 12) AS mu FROM long GROUP BY d),
fit AS (SELECT d, any_value(mu) AS mu, CASE WHEN max(abs(x - mu)) = 0 THEN 1 ELSE max(abs(x - mu)) END AS s FROM long JOIN mu USING (d) GROUP BY d),
codes AS (SELECT id, d, x, mu, s, CAST(greatest(-127, least(127, CASE WHEN (x - mu) / s * 127 >= 0 THEN floor((x - mu) / s * 127 + 0.5::DOUBLE) ELSE -floor(-((x - mu) / s * 127) + 0.5::DOUBLE) END)) AS INT) AS c FROM long JOIN fit USING (d))"""
QUANT = f"""{FIT}, qdots AS (SELECT q.id AS item, r.id, round(sum(q.x * q.s / 127 * r.c), 9) + 0 AS score FROM codes q JOIN codes r ON r.d = q.d AND r.id <> q.id WHERE q.id % 20 = 0 GROUP BY ALL),
quant AS (SELECT item, id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, id) AS rank FROM qdots QUALIFY rank <= 10)"""

SQL = {
    "bm25_postings": f"WITH {BM25} SELECT item, id AS doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, id) AS rank FROM sparse QUALIFY rank <= 10",
    "bm25_topk": f"WITH {BM25} SELECT item, id AS doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, id) AS rank FROM sparse QUALIFY rank <= 10",
    "bm25_topk_exclude": f"WITH {BM25}, {GOLD} SELECT item, id AS doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, id) AS rank FROM sparse ANTI JOIN gold USING (item, id) QUALIFY rank <= 10",
    "bm25_self_control": f"WITH {RANKED}, f AS (SELECT item, min(rank) AS rank FROM bm JOIN gold USING (item, id) WHERE rank <= 10 GROUP BY item), h AS (SELECT DISTINCT item FROM gold) SELECT count(*) AS tried, CAST(coalesce(sum(CAST(rank = 1 AS INT)), 0) AS BIGINT) AS first, CAST(coalesce(sum(CAST(rank IS NOT NULL AS INT)), 0) AS BIGINT) AS found FROM h LEFT JOIN f USING (item)",
    "dense_topk": f"WITH {DENSE} SELECT item, id, score, rank FROM dense WHERE rank <= 10",
    "vector_norms": f"WITH {V}, n AS (SELECT sqrt(list_dot_product(v, v)) AS n FROM v) SELECT round(min(n), 9) AS min_norm, round(max(n), 9) AS max_norm, CAST(count(*) FILTER (n = 0) AS BIGINT) AS zero_rows, count(*) AS rows FROM n",
    "dense_label_recall": f"WITH {DENSE}, gold AS (SELECT q.id AS item, r.id FROM v q JOIN v r ON r.label = q.label AND r.id <> q.id WHERE q.id % 20 = 0), {_measured('dense', 'SELECT id AS item, label FROM v WHERE id % 20 = 0', '')} SELECT CAST(label AS BIGINT) AS label, count(*) AS n, {MEANS} FROM per_item GROUP BY label",
    "quant_fit": f"WITH {FIT} SELECT d, round(mu, 9) AS mu, round(s, 9) AS s FROM fit",
    "quant_codes": f"WITH {FIT} SELECT id, md5(string_agg(CAST(c AS VARCHAR), ',' ORDER BY d)) AS digest FROM codes GROUP BY id",
    "quant_topk": f"WITH {QUANT} SELECT item, id, score, rank FROM quant",
    "quant_agreement": f"""WITH {QUANT}, dots AS (SELECT q.id AS item, r.id, round(list_dot_product(q.v, r.v), 9) + 0 AS score FROM v q JOIN v r ON r.id <> q.id WHERE q.id % 20 = 0), exact AS (SELECT item, id, row_number() OVER (PARTITION BY item ORDER BY score DESC, id) AS rank FROM dots QUALIFY rank <= 10),
        m AS (SELECT item, count(*) FILTER (e.rank IS NOT NULL AND q.rank IS NOT NULL) AS shared, count(e.rank) AS k, max(CASE WHEN e.rank = 1 AND q.rank = 1 THEN 1 ELSE 0 END) AS top FROM exact e FULL JOIN quant q USING (item, id) GROUP BY item)
        SELECT round(avg(CASE WHEN shared = k THEN 1.0 ELSE 0.0 END), 9) AS set_agreement, round(avg(shared / k), 9) AS overlap, round(avg(top), 9) AS top1, count(*) AS n FROM m""",
    "quant_flat_control": f"WITH {FIT}, m AS (SELECT max(abs(x)) AS m FROM long), e AS (SELECT id, avg(abs(x - (mu + c * s / 127))) AS fitted, avg(abs(x - (CASE WHEN x >= 0 THEN floor(x / m * 127 + 0.5::DOUBLE) ELSE -floor(-(x / m * 127) + 0.5::DOUBLE) END) * m / 127)) AS flat FROM codes, m GROUP BY id) SELECT round((SELECT m FROM m), 9) AS abs_max, round(avg(fitted), 8) AS fitted_error, round(avg(flat), 8) AS flat_error FROM e",
    "rrf_fuse": f"WITH {RANKED} SELECT item, id, round(score, 9) AS score, rank FROM fused",
    "rrf_sweep": f"""WITH {RANKED}, ks AS (SELECT CAST(unnest([{", ".join(map(str, SWEEP))}]) AS BIGINT) AS k),
        fk AS (SELECT k, item, id, row_number() OVER (PARTITION BY k, item ORDER BY score DESC, id) AS rank FROM (SELECT k, item, id, round(sum(1 / (k + rank)), 12) AS score FROM both_m, ks GROUP BY ALL) QUALIFY rank <= 50),
        {_measured('fk', 'SELECT item_id AS item, k FROM benchmark, ks', 'k,')} SELECT k, count(*) AS n, round(avg(recall_10), 9) AS recall_10, round(avg(rr), 9) AS mrr FROM per_item GROUP BY k""",
    "rank_cache": f"""WITH {RANKED}, g AS (SELECT item, string_agg(id, ',' ORDER BY id) AS gold FROM gold GROUP BY item), a AS (SELECT item, string_agg(id, ',' ORDER BY rank) AS bm25 FROM bm GROUP BY item), b AS (SELECT item, string_agg(id, ',' ORDER BY rank) AS overlap FROM ovr GROUP BY item)
        SELECT item_id AS item, item_id % 4 AS grp, coalesce(gold, '') AS gold, coalesce(bm25, '') AS bm25, coalesce(overlap, '') AS overlap FROM benchmark LEFT JOIN g ON g.item = item_id LEFT JOIN a ON a.item = item_id LEFT JOIN b ON b.item = item_id""",
    "metrics_cached": f"WITH {RANKED}, {_measured('allm', METHODS, 'method,')} SELECT method, count(*) AS n, round(avg(recall_10), 9) AS recall, round(avg(hit_10), 9) AS hit, round(avg(rr), 9) AS mrr, round(avg(ndcg_10), 9) AS ndcg FROM per_item GROUP BY method",
    "metrics_by_law": f"""WITH {RANKED}, {_measured('allm', "SELECT item_id AS item, item_id % 4 AS grp, method FROM benchmark, (SELECT unnest(['bm25', 'overlap', 'hybrid']) AS method)", 'method,')},
        p AS (SELECT grp, count(DISTINCT item) AS n, round(avg(recall_10) FILTER (method = 'bm25'), 9) AS bm25, round(avg(recall_10) FILTER (method = 'overlap'), 9) AS overlap, round(avg(recall_10) FILTER (method = 'hybrid'), 9) AS hybrid FROM per_item GROUP BY grp)
        SELECT *, hybrid < greatest(bm25, overlap) AS loses, round(hybrid - greatest(bm25, overlap), 9) AS gap FROM p WHERE n >= 8""",
    "metrics_of_group": f"""WITH {RANKED}, f10 AS (SELECT 'hybrid' AS method, item, id, row_number() OVER (PARTITION BY item ORDER BY score DESC, id) AS rank FROM (SELECT item, id, round(sum(1 / (10 + rank)), 12) AS score FROM both_m GROUP BY ALL) QUALIFY rank <= 50),
        r AS (SELECT * FROM both_m UNION ALL SELECT method, item, id, rank FROM f10), h AS (SELECT method, r.item, count(*) FILTER (rank <= 5) AS h5, min(rank) AS first, sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM r JOIN gold ON gold.item = r.item AND gold.id = r.id GROUP BY ALL),
        sz AS (SELECT item, count(*) AS g FROM gold GROUP BY item), i AS ({METHODS})
        SELECT method, count(*) AS n, round(avg(coalesce(h5 / g, 0)), 9) AS recall, round(avg(CASE WHEN h5 > 0 THEN 1.0::DOUBLE ELSE 0 END), 9) AS hit, round(avg(coalesce(1 / first, 0)), 9) AS mrr, round(avg(coalesce(dcg / list_sum([1 / log2(k + 1) FOR k IN range(1, least(g, 5) + 1)]), 0)), 9) AS ndcg
        FROM i LEFT JOIN h USING (item, method) LEFT JOIN sz USING (item) WHERE item % 4 = 1 GROUP BY method""",
    "example_ranks": f"""WITH {RANKED}, f AS (SELECT method, a.item, min(rank) AS r FROM allm a JOIN gold ON gold.item = a.item AND gold.id = a.id GROUP BY ALL)
        SELECT item_id AS item, coalesce(max(r) FILTER (method = 'bm25'), -1) AS bm25, coalesce(max(r) FILTER (method = 'overlap'), -1) AS overlap, coalesce(max(r) FILTER (method = 'hybrid'), -1) AS hybrid FROM benchmark LEFT JOIN f ON f.item = item_id WHERE item_id % 7 = 0 GROUP BY item_id ORDER BY item_id LIMIT 12""",
    "metrics_overall": f"WITH {RANKED}, {_measured('allm', METHODS, 'method,')} SELECT method, count(*) AS n, {MEANS} FROM per_item GROUP BY method",
    "metrics_by_group": f"""WITH {RANKED}, {_measured('allm', "SELECT item_id AS item, item_id % 4 AS grp, method FROM benchmark, (SELECT unnest(['bm25', 'overlap', 'hybrid']) AS method)", 'method,')},
        p AS (SELECT grp, round(avg(recall_10) FILTER (method = 'bm25'), 9) AS bm25, round(avg(recall_10) FILTER (method = 'overlap'), 9) AS overlap, round(avg(recall_10) FILTER (method = 'hybrid'), 9) AS hybrid FROM per_item GROUP BY ROLLUP (grp)) SELECT *, hybrid < greatest(bm25, overlap) AS loses FROM p""",
    "article_rollup": f"WITH {RANKED}, f AS (SELECT item, source, min(rank) AS r FROM bm JOIN documents d ON d.doc_id = bm.id GROUP BY ALL) SELECT item, source, row_number() OVER (PARTITION BY item ORDER BY r, source) AS rank FROM f",
    "gate_verdicts": f"""WITH {RANKED}, {_measured('bm', 'SELECT item_id AS item FROM benchmark', '')}, able AS (SELECT * FROM per_item SEMI JOIN gold USING (item)),
        tops AS (SELECT b.item_id AS item, score, b.item_id IN (SELECT item FROM gold) AS has FROM benchmark b LEFT JOIN bm ON bm.item = b.item_id AND rank = 1),
        o AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS k, count(*) OVER () AS c FROM tops WHERE has AND score IS NOT NULL),
        g AS (SELECT 'sparse_recall' AS gate, coalesce(avg(recall_10), 0) AS value, 0.5::DOUBLE AS threshold, coalesce(avg(recall_10), 0) >= 0.5 AS pass FROM able
        UNION ALL SELECT 'sparse_miss', coalesce(avg(1 - hit_10), 0), 0.1, coalesce(avg(1 - hit_10), 0) >= 0.1 FROM able
        UNION ALL SELECT 'negatives_below', a.v, coalesce(b.t, 0), a.v < coalesce(b.t, 0) FROM (SELECT coalesce(max(score) FILTER (NOT has), 0) AS v FROM tops) a, (SELECT max(score) FILTER (k = least(c // 2, c - 1)) AS t FROM o) b)
        SELECT gate, round(value, 9) AS value, threshold, pass FROM g""",
    "set_agreement": f"""WITH {RANKED}, s AS (SELECT item, id, min(rank) FILTER (method = 'bm25') AS a, min(rank) FILTER (method = 'overlap') AS b FROM both_m WHERE rank <= 10 GROUP BY ALL)
        SELECT item, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS shared, count(*) FILTER (b IS NULL) AS only_bm25, count(*) FILTER (a IS NULL) AS only_overlap, min(CASE WHEN a IS DISTINCT FROM b THEN least(a, b) END) AS first_difference FROM s GROUP BY item""",
    "stride_sample": "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, greatest(count(*) OVER () // 100, 1) AS step FROM documents) SELECT doc_id, idx FROM r WHERE idx % step = 0 AND idx / step < 100",
    "review_flags": f"""WITH {GOLD}, i AS (SELECT item_id AS item, text, (SELECT count(*) FROM gold WHERE gold.item = item_id) AS g, {SEGMENTS} AS seg FROM benchmark)
        SELECT item, concat_ws(',', CASE WHEN g = 0 THEN 'gold_missing' END, CASE WHEN g >= 5 THEN 'gold_many' END, CASE WHEN length(text) > 200 THEN 'long' END, CASE WHEN coalesce(list_sum([length(x) FOR x IN seg]), 0) < 20 THEN 'bare' END) AS flags FROM i""",
}
