"""Queries on controls, twins, variants, evaluation-set statistics, files' lines, SQL functions and stateful streams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkshelf.functions import registered
from sparkshelf.functions import text as T
from sparkshelf.functions.numerals import NUMERAL
from sparkshelf.operators import checks, eventlog, evalpack, evalset, index, metrics, ranking, sparse_blocks, sparse_profiles
from sparkshelf.plans import labels, logs
from sparkshelf.plans.retrieval import BM25, DENSE, GOLD, PAIR, MEANS, METHODS, RANKED, V, _docs, _gold, _items, _pack, _rankings, _vector_queries, _vectors, _measured
from sparkshelf.plans.text import BIGRAMS, INDEX, SEGMENTS
from sparkshelf.session import cut, scratch, table
from sparkshelf.sources import files, statutes
from sparkshelf.streaming import events as streams

PREFIXES = {"plain": "", "query": "query: ", "passage": "passage: "}
THRESHOLD = 150


def dense_control(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return checks.dense_control(rows, rows.where("id % 20 = 0"))


def dense_full_sort(spark, sf_dir):
    """The plain twin of dense_topk."""
    rows = _vectors(spark, sf_dir)
    return checks.full_sort(rows, _vector_queries(rows), 10).select("item", "id", "score", F.col("rank").cast("long").alias("rank"))


def fusion_twins(spark, sf_dir):
    """Fused ranks by grouping rows and by arrays within a row."""
    rows = ranking.fuse(_rankings(spark, sf_dir)).select("item", "id", F.col("rank").cast("long").alias("by_rows"))
    packed = _pack(spark, sf_dir)
    arrays = packed.select("item", F.posexplode(evalpack.fused([F.col(m) for m in PAIR])).alias("p", "id")).select("item", "id", (F.col("p") + 1).cast("long").alias("by_arrays"))
    return rows.join(arrays, ["item", "id"], "full")


def metric_twins(spark, sf_dir):
    """Recall at 10 and first hit by joins and by arrays."""
    items = _items(spark, sf_dir).select("item").crossJoin(F.broadcast(spark.createDataFrame([(m,) for m in PAIR], "method string")))
    joined = metrics.per_item(_rankings(spark, sf_dir), _gold(spark, sf_dir), items, ("method",)).select("item", "method", F.round("recall_10", 9).alias("recall_joins"), F.round("rr", 9).alias("rr_joins"))
    arrays = evalpack.per_item(_pack(spark, sf_dir), PAIR).select("item", "method", F.round("recall", 9).alias("recall_arrays"), F.round("rr", 9).alias("rr_arrays"))
    return joined.join(arrays, ["item", "method"])


def prefix_variants(spark, sf_dir):
    """Recall of the items' texts with other words before them, against those with the prefix for queries; all variants in one ranking."""
    many = len(PREFIXES)
    asked = None
    for v, prefix in enumerate(PREFIXES.values()):
        own = _items(spark, sf_dir).select((F.col("item") * many + v).alias("item"), T.prefixed(F.col("text"), prefix).alias("text"))
        asked = own if asked is None else asked.unionByName(own)
    found = sparse_blocks.rank(_docs(spark, sf_dir), asked)
    names = F.element_at(F.array(*[F.lit(n) for n in PREFIXES]), (F.col("item") % many + 1).cast("int"))
    ranked = found.select(names.alias("variant"), F.floor(F.col("item") / many).alias("item"), "id", "rank")
    return checks.variants(ranked, _gold(spark, sf_dir), _items(spark, sf_dir), "query")


def oracle_statistics(spark, sf_dir):
    return checks.set_statistics(evalset.items(labels._chunks(spark, sf_dir)))


def oracle_by_law(spark, sf_dir):
    return evalset.items(labels._chunks(spark, sf_dir)).groupBy("law_id").agg(F.count(F.lit(1)).alias("n"))


def _articles(chunks):
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "text"))), lambda x: x["text"]), "")
    return chunks.groupBy("law_id", "article").agg(joined.alias("text"), F.min("chunk_idx").alias("chunk_idx"))


def granularity_samples(spark, sf_dir):
    chunks = labels._chunks(spark, sf_dir)
    return checks.samples(_articles(chunks), chunks, parts=2, shortest=100).select("law_id", "article", F.md5("text").alias("digest"), F.size("paragraphs").cast("long").alias("parts"))


def granularity_metrics(spark, sf_dir):
    """The items moved to articles, ranked by paragraphs rolled up to articles and by articles indexed natively; an item's own paragraph or article is left out."""
    chunks = cut(labels._chunks(spark, sf_dir).withColumn("art", F.substring("law_id", 2, 9).cast("long") * 1000 + F.col("article").cast("long")))
    found = cut(evalset.items(chunks))
    moved = evalset.to_articles(found, chunks).where("reason IS NULL").select("item", F.col("gold").alias("arts"))
    own = found.join(moved, "item").join(chunks.select(F.col("id").alias("source"), "chunk_idx", "art"), "source")
    own = cut(own.select((F.col("chunk_idx") * 100 + F.element_at(F.split("item", "@"), 2).cast("long")).alias("item"), F.col("query").alias("text"), "chunk_idx", "art", "arts"))
    of_law = F.substring_index(F.col("a"), "#", 1)
    gold = own.select("item", F.explode("arts").alias("a")).select("item", (F.substring(of_law, 2, 9).cast("long") * 1000 + F.substring_index("a", "#", -1).cast("long")).alias("id"))
    by_part = sparse_profiles.rank(chunks.select(F.col("chunk_idx").alias("id"), "text"), own.select("item", "text", F.col("chunk_idx").alias("own")))
    rolled = ranking.roll_up(by_part.select("item", "id", "rank"), chunks.select(F.col("chunk_idx").alias("id"), F.col("art").alias("parent")))
    articles = cut(_articles(chunks).select((F.substring("law_id", 2, 9).cast("long") * 1000 + F.col("article").cast("long")).alias("id"), "text"))  # read twice for every group of queries
    native = sparse_profiles.rank(articles, own.select("item", "text", F.col("art").alias("own")))
    both = rolled.select(F.lit("paragraph").alias("granularity"), "item", "id", "rank").unionByName(native.select(F.lit("article").alias("granularity"), "item", "id", "rank"))
    items = own.select("item").crossJoin(F.broadcast(spark.createDataFrame([("paragraph",), ("article",)], "granularity string")))
    return metrics.means(metrics.per_item(both, gold, items, ("granularity",)), "granularity").select("granularity", "n", "recall_10", "hit_10", "mrr")


def ids_rebuilt(spark, sf_dir):
    chunks = labels._chunks(spark, sf_dir).select(F.substring("law_id", 2, 9).cast("long").alias("law"), "article", "paragraph")
    laws = chunks.select("law").distinct().select("law", F.concat(F.lit("L"), "law").alias("law_id"))
    return checks.rebuilt_ids(chunks, laws)


def ids_decomposed(spark, sf_dir):
    return labels._chunks(spark, sf_dir).select("id", statutes.address(F.col("id")).alias("a")).select("id", "a.*")


def oracle_flags(spark, sf_dir):
    """Reviewers' flags of all derived items, and of twins of them with a leak, a lost and an own gold and a bare query."""
    chunks = labels._chunks(spark, sf_dir)
    found = cut(evalset.items(chunks).select("item", "source", "query", "gold"))
    spoiled = found.select(F.concat("item", F.lit("x")).alias("item"), "source", F.concat(F.substring("query", 1, 9), F.lit("第三条、。（）")).alias("query"), F.array(F.lit("none"), F.col("source")).alias("gold"))
    return evalset.flags(found.unionByName(spoiled), chunks)


def metrics_rolled_up(spark, sf_dir):
    """All methods at all cuts, with rankings and gold rolled up from documents to their sources."""
    both = _rankings(spark, sf_dir)
    parent = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("parent"))
    fused = ranking.fuse(both).select(F.lit("hybrid").alias("method"), "item", "id", "rank")
    rolled = ranking.roll_up(both.unionByName(fused), parent, ("method", "item"))
    gold = _gold(spark, sf_dir).join(parent, "id").select("item", F.col("parent").alias("id")).distinct()
    items = _items(spark, sf_dir).select("item").crossJoin(F.broadcast(spark.createDataFrame([(m,) for m in (*PAIR, "hybrid")], "method string")))
    return metrics.means(metrics.per_item(rolled, gold, items, ("method",)), "method")


def token_layers(spark, sf_dir):
    """Tokens and distinct tokens of each document by expressions and by arrays of code points."""

    def counted(batches):
        for b in batches:
            rows, _, tf, lengths = sparse_blocks.counted(b.column("text").to_pylist())
            distinct = pa.array([int(n) for n in np.bincount(rows, minlength=b.num_rows)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lengths.astype("int64")), distinct], ["doc_id", "tokens_arrays", "distinct_arrays"])

    docs = table(spark, sf_dir, "documents")
    own = docs.select("doc_id", T.token_length("text").alias("tokens"), F.size(T.bigrams("text")).cast("long").alias("distinct"))
    return own.join(docs.select("doc_id", "text").mapInArrow(counted, "doc_id long, tokens_arrays long, distinct_arrays long"), "doc_id")


def stored_index_topk(spark, sf_dir):
    """bm25_topk from an index that was stored in packed form."""
    path = f"{scratch(spark)}/index"
    index.store_texts(table(spark, sf_dir, "documents"), path, "doc_id")
    return ranking.bm25_stored(spark, path, _items(spark, sf_dir), 10).select("item", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


def sql_functions(spark, sf_dir):
    registered.register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return spark.sql("SELECT doc_id, CAST(size(segments(text)) AS BIGINT) AS n_segments, token_length(text) AS tokens, CAST(size(bigrams(text)) AS BIGINT) AS distinct_bigrams, substantive_length(text) AS substantive, CAST(length(without_space(text)) AS BIGINT) AS n_chars, int_to_kanji(doc_id) AS kanji, CAST(kanji_to_int(int_to_kanji(doc_id)) AS BIGINT) AS back, round_half_away(doc_id / 2D - 50D) AS half, dot(array(1D, doc_id), array(2D, 3D)) AS product FROM documents")


#: Lines and outputs in words that both engines understand.
LINES = "SELECT p_partkey AS k, p_name || CASE p_partkey % 9 WHEN 0 THEN ' а' WHEN 1 THEN ' 가' WHEN 2 THEN ' Ω' WHEN 3 THEN ' Ａ' WHEN 4 THEN chr(7) WHEN 5 THEN ' а text-hygiene:allow' WHEN 6 THEN ' аΩ' ELSE '' END AS text FROM part"
OUTPUTS = "SELECT p_partkey AS k, p_partkey % 3 AS code, CASE p_partkey % 7 WHEN 0 THEN chr(27) || '[32m' || p_size || ' passed' || chr(27) || '[0m' WHEN 1 THEN 'no tests ran in 0.1s' WHEN 2 THEN 'Ran ' || p_size || ' tests' WHEN 3 THEN 'x: Command not found' WHEN 4 THEN 'passed' WHEN 5 THEN p_size || ' failed' ELSE '' END AS output FROM part"
DIFF = "SELECT 'd' || (p_partkey % 7) AS name, p_partkey // 7 AS p, CASE (p_partkey // 7) % 6 WHEN 0 THEN '+++ b/f' || (p_partkey // 42) || '.py' WHEN 1 THEN '@@ -1,2 +' || (p_partkey % 90 + 1) || ',3 @@ x' WHEN 5 THEN '-' || p_name WHEN 4 THEN CASE WHEN p_partkey % 2 = 0 THEN '@@ -9 +' || (p_partkey % 50 + 100) || ' @@' ELSE '+' || p_size END ELSE '+' || p_name END AS value FROM part"


def _made(spark, sf_dir, sql):
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql(sql.replace(" // ", " div "))


def hygiene_lines(spark, sf_dir):
    """Kinds of foreign characters in generated lines."""
    found = _made(spark, sf_dir, LINES)
    return found.select("k", F.array_join(F.array_sort(T.violations(F.col("text"))), ",").alias("kinds")).where("kinds != ''")


def run_evidence(spark, sf_dir):
    """Why generated outputs of test runs are no evidence."""
    return _made(spark, sf_dir, OUTPUTS).select("k", checks.ran(F.col("output"), F.col("code")).alias("reason"))


def diff_added(spark, sf_dir):
    return files.added_lines(_made(spark, sf_dir, DIFF)).select("file", "line", "text")


def validation_run(spark, sf_dir):
    """Violations of the generated logs by severity."""
    found, _ = checks.validation(logs._parsed(spark, sf_dir), logs._taxonomy(spark))
    return found.groupBy("severity", "rule").agg(F.count(F.lit(1)).alias("n"))


def stream_alerts(spark, sf_dir):
    """Users, in a stream, whose events reach a number."""
    return streams.drain(streams.alerts(streams.read(spark, f"{sf_dir}/events.parquet"), THRESHOLD // 10, "user_id"), "append")


def stream_late(spark, sf_dir):
    """Events, in a stream, that come after a later one of their user, in an order that ids mixed up give."""
    shuffled = streams.read(spark, f"{sf_dir}/events.parquet").withColumn("event_id", F.col("event_id") * 7919 % 1000003)
    found = streams.drain(streams.late_rows(shuffled), "append")
    return found.select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "behind")


QUERIES = [dense_control, dense_full_sort, fusion_twins, metric_twins, prefix_variants, oracle_statistics, oracle_by_law, granularity_samples, granularity_metrics, ids_rebuilt, ids_decomposed, oracle_flags, metrics_rolled_up, token_layers, stored_index_topk, sql_functions, hygiene_lines, run_evidence, diff_added, validation_run, stream_alerts, stream_late]



def _bm25_sql(name: str, docs: str, queries: str, barred: str) -> str:
    """CTE ``name`` (item, id, rank): BM25 of a query table (item, text) over a table of docs (id, text), without the pairs (item, id) of ``barred``."""
    return f"""{name}_t AS (SELECT id, {BIGRAMS} AS b FROM (SELECT id, {SEGMENTS} AS seg FROM {docs})), {name}_p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(b) AS term FROM {name}_t) GROUP BY ALL), {name}_d AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
{name}_l AS (SELECT id, len(b) AS dl FROM {name}_t), {name}_n AS (SELECT count(*) AS n, CAST(sum(dl) AS DOUBLE) / count(*) AS avgdl FROM {name}_l), {name}_q AS (SELECT DISTINCT item, unnest({BIGRAMS}) AS term FROM (SELECT item, {SEGMENTS} AS seg FROM {queries})),
{name}_s AS (SELECT item, p.id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score FROM {name}_q JOIN {name}_p p USING (term) JOIN {name}_d USING (term) JOIN {name}_l l ON l.id = p.id, {name}_n GROUP BY ALL HAVING score > 0),
{name} AS (SELECT item, id, row_number() OVER (PARTITION BY item ORDER BY score DESC, id) AS rank FROM {name}_s ANTI JOIN {barred} USING (item, id) QUALIFY rank <= 50)"""


_PLAIN = "regexp_replace(output, '\\x1b\\[[0-9;]*[A-Za-z]', '', 'g')"
SQL = {
    "dense_control": f"""WITH {V}, dots AS (SELECT q.id AS item, r.id, round(list_dot_product(q.v, r.v), 9) + 0 AS score, q.v = r.v AS twin FROM v q JOIN v r ON true WHERE q.id % 20 = 0), top AS (SELECT * FROM dots QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, id) = 1)
        SELECT count(*) AS tried, count(*) FILTER (id = item) AS own, count(*) FILTER (id <> item AND twin) AS twin, count(*) FILTER (NOT twin) AS missed, round(count(*) FILTER (twin) / count(*), 9) AS rate FROM top""",
    "dense_full_sort": f"WITH {DENSE} SELECT item, id, score, rank FROM dense WHERE rank <= 10",
    "fusion_twins": f"WITH {RANKED} SELECT item, id, rank AS by_rows, rank AS by_arrays FROM fused",
    "metric_twins": f"WITH {RANKED}, {_measured('both_m', "SELECT item_id AS item, method FROM benchmark, (SELECT unnest(['bm25', 'overlap']) AS method)", 'method,')} SELECT item, method, round(recall_10, 9) AS recall_joins, round(rr, 9) AS rr_joins, round(recall_10, 9) AS recall_arrays, round(rr, 9) AS rr_arrays FROM per_item",
    "prefix_variants": f"""WITH {INDEX}, {GOLD}, qv AS ({" UNION ALL ".join(f"SELECT '{n}' AS variant, item_id AS item, '{p}' || text AS text FROM benchmark" for n, p in PREFIXES.items())}),
        qseg AS (SELECT variant, item, {SEGMENTS} AS seg FROM qv), terms AS (SELECT DISTINCT variant, item, unnest({BIGRAMS}) AS term FROM qseg),
        sc AS (SELECT variant, item, p.id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score FROM terms JOIN postings p USING (term) JOIN dfs USING (term) JOIN lengths l ON l.id = p.id, stats GROUP BY ALL HAVING score > 0),
        r AS (SELECT variant, item, id, row_number() OVER (PARTITION BY variant, item ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 50),
        {_measured('r', 'SELECT DISTINCT variant, item FROM qv', 'variant,')},
        m AS (SELECT variant, round(avg(recall_10), 9) AS recall_10, round(avg(hit_10), 9) AS hit_10, round(avg(rr), 9) AS mrr FROM per_item GROUP BY variant), b AS (SELECT recall_10 AS base FROM m WHERE variant = 'query')
        SELECT m.*, round(recall_10 - base, 9) AS drop, round((recall_10 - base) / nullif(base, 0), 9) AS relative FROM m, b""",
    "oracle_statistics": f"""WITH {labels.DERIVED}, o AS (SELECT length(query) AS n, row_number() OVER (ORDER BY length(query)) - 1 AS k, count(*) OVER () AS c FROM items)
        SELECT (SELECT count(*) FROM items) AS items, (SELECT count(*) FROM items WHERE len(gold) = 1) AS one, (SELECT count(*) FROM items WHERE len(gold) > 1) AS many, CAST((SELECT max(len(gold)) FROM items) AS BIGINT) AS most, min(n) AS shortest, max(n) FILTER (k = least(c // 2, c - 1)) AS middle, max(n) AS longest FROM o""",
    "oracle_by_law": f"WITH {labels.DERIVED} SELECT law_id, count(*) AS n FROM items GROUP BY law_id",
    "granularity_samples": f"""WITH {labels.CHUNKS}, a AS (SELECT law_id, article, string_agg(text, '' ORDER BY chunk_idx) AS text, count(*) AS parts, min(chunk_idx) AS first FROM chunks GROUP BY ALL)
        SELECT law_id, article, md5(text) AS digest, parts FROM a WHERE parts >= 2 AND length(text) > 100 AND length(text) < 900 ORDER BY first LIMIT 6""",
    "granularity_metrics": f"""WITH {labels.DERIVED}, gart AS (SELECT id, law_id, article, chunk_idx, CAST(substr(law_id, 2) AS BIGINT) * 1000 + CAST(article AS BIGINT) AS art, text FROM chunks),
        gg AS (SELECT i.item, i.query, s.chunk_idx * 100 + CAST(split_part(i.item, '@', 2) AS BIGINT) AS num, s.chunk_idx, s.art, list_distinct(list(g.art)) AS arts FROM (SELECT item, source, query, unnest(gold) AS gid FROM items) i JOIN gart g ON g.id = i.gid JOIN gart s ON s.id = i.source GROUP BY ALL),
        own AS (SELECT num AS item, query AS text, chunk_idx, art, arts FROM gg WHERE NOT list_contains(arts, art)), gold AS (SELECT item, unnest(arts) AS id FROM own),
        dp AS (SELECT chunk_idx AS id, text FROM gart), da AS (SELECT art AS id, string_agg(text, '' ORDER BY chunk_idx) AS text FROM gart GROUP BY art), bp AS (SELECT item, chunk_idx AS id FROM own), ba AS (SELECT item, art AS id FROM own),
        {_bm25_sql('rp', 'dp', 'own', 'bp')}, {_bm25_sql('ra', 'da', 'own', 'ba')},
        rolled AS (SELECT item, art AS id, row_number() OVER (PARTITION BY item ORDER BY r, art) AS rank FROM (SELECT item, art, min(rank) AS r FROM rp JOIN gart ON gart.chunk_idx = rp.id GROUP BY ALL)),
        rr AS (SELECT 'paragraph' AS granularity, item, id, rank FROM rolled UNION ALL SELECT 'article', item, id, rank FROM ra),
        {_measured('rr', "SELECT item, granularity FROM own, (SELECT unnest(['paragraph', 'article']) AS granularity)", 'granularity,')}
        SELECT granularity, count(*) AS n, round(avg(recall_10), 9) AS recall_10, round(avg(hit_10), 9) AS hit_10, round(avg(rr), 9) AS mrr FROM per_item GROUP BY granularity""",
    "ids_rebuilt": f"WITH {labels.CHUNKS} SELECT CAST(substr(law_id, 2) AS BIGINT) AS law, article, paragraph, id FROM chunks",
    "ids_decomposed": f"WITH {labels.CHUNKS} SELECT id, law_id, article, paragraph FROM chunks",
    "oracle_flags": f"""WITH {labels.DERIVED}, o AS (SELECT item, source, query, gold FROM items UNION ALL SELECT item || 'x', source, substr(query, 1, 9) || '第三条、。（）', ['none', source] FROM items), lost AS (SELECT item, count(*) AS lost FROM (SELECT item, unnest(gold) AS g FROM o) WHERE g NOT IN (SELECT id FROM chunks) GROUP BY item)
        SELECT o.item, concat_ws(',', CASE WHEN regexp_matches(query, '第{NUMERAL}条') THEN 'mask_leak' END, CASE WHEN len(gold) >= 5 THEN 'gold_many' END, CASE WHEN length(query) > 200 THEN 'long' END, CASE WHEN list_contains(gold, source) THEN 'gold_is_source' END,
            CASE WHEN lost > 0 THEN 'gold_missing' END, CASE WHEN length(regexp_replace(query, '[、。「」（）()]', '', 'g')) < 20 THEN 'bare' END) AS flags FROM o LEFT JOIN lost USING (item)""",
    "metrics_rolled_up": f"""WITH {RANKED.replace("gold AS", "gold0 AS")}, gold AS (SELECT DISTINCT item, source AS id FROM gold0 JOIN documents ON doc_id = id), rolled AS (SELECT method, item, source AS id, row_number() OVER (PARTITION BY method, item ORDER BY r, source) AS rank FROM (SELECT method, item, source, min(rank) AS r FROM allm JOIN documents ON doc_id = id GROUP BY ALL)),
        {_measured('rolled', METHODS, 'method,')} SELECT method, count(*) AS n, {MEANS} FROM per_item GROUP BY method""",
    "token_layers": f"WITH {INDEX} SELECT id AS doc_id, CAST(len(b) AS BIGINT) AS tokens, CAST(len(list_distinct(b)) AS BIGINT) AS distinct, CAST(len(b) AS BIGINT) AS tokens_arrays, CAST(len(list_distinct(b)) AS BIGINT) AS distinct_arrays FROM toks",
    "stored_index_topk": f"WITH {BM25} SELECT item, id AS doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, id) AS rank FROM sparse QUALIFY rank <= 10",
    "sql_functions": f"""WITH {INDEX} SELECT t.id AS doc_id, CAST(len(seg) AS BIGINT) AS n_segments, CAST(len(b) AS BIGINT) AS tokens, CAST(len(list_distinct(b)) AS BIGINT) AS distinct_bigrams, CAST(coalesce(list_sum([length(g) FOR g IN seg]), 0) AS BIGINT) AS substantive, CAST(length(regexp_replace(text, '[{T.SPACE}]+', '', 'g')) AS BIGINT) AS n_chars,
        {labels.kanji('t.id')} AS kanji, CASE WHEN t.id BETWEEN 1 AND 9999 THEN t.id END AS back, CAST(CASE WHEN t.id >= 100 THEN floor(t.id / 2 - 50 + 0.5) ELSE -floor(-(t.id / 2 - 50) + 0.5) END AS BIGINT) AS half, CAST(2 + 3 * t.id AS DOUBLE) AS product FROM toks t JOIN documents d ON d.doc_id = t.id""",
    "hygiene_lines": f"WITH l AS ({LINES}), v AS (SELECT k, kind FROM l, (VALUES {', '.join(f"('{k}', '{r}')" for k, r in T.FOREIGN.items())}) t(kind, re) WHERE NOT contains(text, '{T.ALLOW_MARK}') AND regexp_matches(text, re)) SELECT k, string_agg(kind, ',' ORDER BY kind) AS kinds FROM v GROUP BY k",
    "run_evidence": f"""WITH o AS (SELECT k, code, {_PLAIN} AS t FROM ({OUTPUTS})) SELECT k, CASE {" ".join(f"WHEN contains(lower(t), '{p}') THEN '{p}'" for p in checks.NOT_RAN)} WHEN code = 127 THEN 'command not found'
        WHEN code = 0 AND NOT ({" OR ".join(f"regexp_matches(t, '{r}')" for r in checks.RAN)}) THEN 'no count of tests' END AS reason FROM o""",
    "diff_added": f"""WITH d AS ({DIFF}), h AS (SELECT *, last_value(CASE WHEN starts_with(value, '+++ ') THEN substr(value, 7) END IGNORE NULLS) OVER w AS file, last_value(CASE WHEN starts_with(value, '@@') THEN CAST(regexp_extract(value, '\\+([0-9]+)', 1) AS BIGINT) END IGNORE NULLS) OVER w AS f,
        sum(CASE WHEN starts_with(value, '@@') THEN 1 ELSE 0 END) OVER w AS hunk, starts_with(value, '+') AND NOT starts_with(value, '+++') AS added FROM d WINDOW w AS (PARTITION BY name ORDER BY p ROWS UNBOUNDED PRECEDING))
        SELECT file, CAST(f + sum(CASE WHEN added THEN 1 ELSE 0 END) OVER (PARTITION BY name, hunk ORDER BY p ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS line, substr(value, 2) AS text FROM h QUALIFY added""",
    "validation_run": f"WITH {logs.PARSED}, {logs._FILES}, a AS (SELECT rule, 'error' AS severity FROM ({logs._records_sql()}) UNION ALL SELECT DISTINCT ON (file, rule, severity) rule, severity FROM found WHERE rule <> 'no_records') SELECT severity, rule, count(*) AS n FROM a GROUP BY ALL",
    "stream_alerts": f"SELECT CAST(user_id AS VARCHAR) AS key, CAST({THRESHOLD // 10} AS BIGINT) AS reached FROM events GROUP BY user_id HAVING count(*) >= {THRESHOLD // 10}",
    "stream_late": "WITH m AS (SELECT event_id * 7919 % 1000003 AS event_id, user_id, ts FROM events), e AS (SELECT event_id, user_id, ts, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM m) SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, epoch_us(seen) - epoch_us(ts) AS behind FROM e WHERE seen > ts",
}
