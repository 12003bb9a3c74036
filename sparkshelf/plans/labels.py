"""Queries on numerals, citations and the derivation of labelled queries, over statutes generated from the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkshelf.functions import citations as C
from sparkshelf.functions import numerals as N
from sparkshelf.operators import evalset
from sparkshelf.plans.text import BIGRAMS, SEGMENTS
from sparkshelf.session import scratch, table
from sparkshelf.sources import statutes


def _numbers(spark):
    return spark.range(0, 10001).select(F.col("id").alias("n"))


def _chunks(spark, sf_dir):
    return statutes.generated(table(spark, sf_dir, "part"))


def int_to_kanji(spark, sf_dir):
    return _numbers(spark).select("n", N.int_to_kanji(F.col("n")).alias("kanji"))


def kanji_to_int(spark, sf_dir):
    return _numbers(spark).select(N.int_to_kanji(F.col("n")).alias("kanji")).select("kanji", N.kanji_to_int(F.col("kanji")).cast("long").alias("n"))


def article_label(spark, sf_dir):
    number = F.when(F.col("n") % 3 == 0, F.concat_ws("_", F.col("n").cast("string"), (F.col("n") % 7 + 1).cast("string"))).otherwise(F.col("n").cast("string"))
    labels = _numbers(spark).where("n BETWEEN 1 AND 9999").select("n", N.number_to_label(number).alias("label"))
    return labels.select("n", "label", N.label_to_number(F.col("label")).alias("number"))


def statute_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir)


def refs_extract(spark, sf_dir):
    r = evalset.references(_chunks(spark, sf_dir))
    return r.select("id", F.col("si").cast("long").alias("si"), F.col("k").cast("long").alias("k"), "raw", F.col("start").cast("long").alias("start"), "article", "paragraph", "item", "external")


def refs_mask(spark, sf_dir):
    s = evalset.sentences(_chunks(spark, sf_dir))
    return s.select("id", F.col("si").cast("long").alias("si"), C.masked(F.col("sentence")).alias("masked"))


def refs_relative_counts(spark, sf_dir):
    found = evalset.sentences(_chunks(spark, sf_dir)).select(F.explode(C.relative_counts(F.col("sentence"))).alias("pattern"))
    return found.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def oracle_items(spark, sf_dir):
    found = evalset.items(_chunks(spark, sf_dir))
    return found.select("item", "source", "law_id", "query", F.array_join("gold", ",").alias("gold"))


def oracle_rejects(spark, sf_dir):
    return evalset.rejections(_chunks(spark, sf_dir))


def oracle_reference_counts(spark, sf_dir):
    return evalset.reference_counts(_chunks(spark, sf_dir))


def granularity_compare(spark, sf_dir):
    """Items moved from paragraphs to articles, by what becomes of them."""
    chunks = _chunks(spark, sf_dir)
    moved = evalset.to_articles(evalset.items(chunks), chunks)
    return moved.groupBy(F.coalesce("reason", F.lit("kept")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("gold")).alias("gold"))


def _files(spark, sf_dir):
    path = f"{scratch(spark)}/laws"
    statutes.write_generated(table(spark, sf_dir, "part"), path)
    return statutes.read_laws(spark, f"{path}/*")


def statute_files(spark, sf_dir):
    """Paragraphs of laws that were written as tag-tree files, and the count of supplementary articles as a row each."""
    rows = _files(spark, sf_dir)
    return rows.select("law_id", "law_num", "title", "article", "caption", "label", "chapter", "section", "paragraph", "text", "in_main")


def statute_articles(spark, sf_dir):
    """The files' articles as chunks."""
    return statutes.chunks(_files(spark, sf_dir).where("law_id IS NOT NULL"), "article").select("id", "law_id", "article", "caption", "chapter", "text", "index_text")


QUERIES = [statute_files, statute_articles, int_to_kanji, kanji_to_int, article_label, statute_chunks, refs_extract, refs_mask, refs_relative_counts, oracle_items, oracle_rejects, oracle_reference_counts, granularity_compare]


def kanji(n: str) -> str:
    parts = [f"CASE WHEN (({n}) // {v}) % 10 > 1 THEN substr('{N.DIGITS}', CAST((({n}) // {v}) % 10 AS BIGINT), 1) || '{u}' WHEN (({n}) // {v}) % 10 = 1 THEN '{u}' ELSE '' END" for u, v in N.UNITS.items()]
    parts.append(f"CASE WHEN ({n}) % 10 > 0 THEN substr('{N.DIGITS}', CAST(({n}) % 10 AS BIGINT), 1) ELSE '' END")
    return f"(CASE WHEN ({n}) BETWEEN 1 AND 9999 THEN {' || '.join(parts)} END)"


def _target(by: int, add: int) -> str:
    return f"'第' || {kanji(f'(k * {by} + {add}) % 301 + 1')} || '条'"


NAME = "translate(lower(p_name), ' #0123456789', '  零壱弐参四五六七八九') || '及び' || lower(p_type) || '及び' || chr(CAST(k % 6000 + 13312 AS INT)) || chr(CAST((k + 2000) % 6000 + 13312 AS INT)) || chr(CAST(k * 2 % 6000 + 13312 AS INT)) || chr(CAST(k * 3 % 6000 + 13312 AS INT)) || 'に係る届出を、遅滞なく主務大臣に提出しなければならない。'"
CHUNKS = f"""p AS (SELECT p_partkey AS k, p_name, p_type FROM part),
chunks AS (SELECT 'L' || (k % 3) || '#' || (k // 3 % 331 + 1) || '-' || (k // 993 + 1) AS id, 'L' || (k % 3) AS law_id, CAST(k // 3 % 331 + 1 AS VARCHAR) AS article, CAST(k // 993 + 1 AS VARCHAR) AS paragraph, k AS chunk_idx,
    CASE WHEN k % 11 = 0 THEN '民法' || {_target(3, 1)} || 'の規定は、' || {NAME}
    WHEN k % 13 = 0 THEN {" || ".join(f"{_target(5, i)} || '、'" for i in range(5))} || {NAME}
    WHEN k % 17 = 0 THEN '前項の規定は、' || {_target(1, 7)} || '第二項' || 'の場合について準用する。'
    WHEN k % 5 = 0 THEN {_target(7, 2)} || 'の二第三項第一号の規定により、' || {NAME} || 'ただし、前条の規定は、この限りでない。'
    ELSE {_target(2, 9)} || '第一項の規定により、' || {NAME} || '同条の規定は、適用しない。' END AS text FROM p)"""
SENTENCES = f"""{CHUNKS}, sl AS (SELECT *, [y FOR y IN [trim(x) FOR x IN regexp_extract_all(text, '[^。]*。|[^。]+$')] IF y <> ''] AS l FROM chunks),
sent AS (SELECT id, law_id, article AS source_article, unnest(range(len(l))) AS si, unnest(l) AS sentence FROM sl)"""
REFS = f"""{SENTENCES}, nums AS (SELECT CAST(n AS VARCHAR) AS n, {kanji('n')} AS kj FROM range(1, 10000) t(n)),
found AS (SELECT *, regexp_extract_all(sentence, '{C.CITATION}') AS raws, regexp_split_to_array(sentence, '{C.CITATION}') AS gaps,
    regexp_extract_all(sentence, '{C.CITATION}', 1) AS ga, regexp_extract_all(sentence, '{C.CITATION}', 2) AS gb, regexp_extract_all(sentence, '{C.CITATION}', 3) AS gp, regexp_extract_all(sentence, '{C.CITATION}', 4) AS gi FROM sent),
one AS (SELECT *, unnest(range(len(raws))) AS k FROM found),
prefix AS (SELECT *, raws[k + 1] AS raw, array_to_string(flatten([[gaps[CAST(j AS BIGINT)], raws[CAST(j AS BIGINT)]] FOR j IN range(1, k + 1)]), '') || gaps[k + 1] AS before FROM one),
refs0 AS (SELECT prefix.id, law_id, source_article, si, k, sentence, raw, CAST(length(before) AS BIGINT) AS start, a.n || coalesce('_' || b.n, '') AS article, pp.n AS paragraph, ii.n AS item,
    regexp_matches(before, '{C.LAW_CITATION_END}') OR regexp_matches(before, '{C.LAW_NAME_END}') AS external
    FROM prefix LEFT JOIN nums a ON a.kj = ga[k + 1] LEFT JOIN nums b ON b.kj = substr(gb[k + 1], 2) LEFT JOIN nums pp ON pp.kj = gp[k + 1] LEFT JOIN nums ii ON ii.kj = gi[k + 1]),
refs AS (SELECT * EXCLUDE (k), row_number() OVER (PARTITION BY id, si ORDER BY k) - 1 AS k FROM refs0 WHERE NOT (start = 0 AND length(raw) = length(sentence) AND paragraph IS NULL AND item IS NULL))"""
DERIVED = f"""{REFS}, known AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY law_id, article, paragraph ORDER BY chunk_idx DESC) = 1),
firsts AS (SELECT law_id, article, arg_min(id, (CASE WHEN paragraph = '1' THEN 0 ELSE 1 END) * 100000000 + chunk_idx) AS first FROM known GROUP BY ALL),
res AS (SELECT r.*, e.id AS exact, f.first, CASE WHEN r.article = source_article THEN 'self' WHEN f.first IS NULL THEN 'missing' WHEN r.paragraph IS NOT NULL AND e.id IS NULL THEN 'fell_back' ELSE 'found' END AS outcome
    FROM refs r LEFT JOIN known e ON e.law_id = r.law_id AND e.article = r.article AND e.paragraph = r.paragraph LEFT JOIN firsts f ON f.law_id = r.law_id AND f.article = r.article WHERE NOT external),
per_ref AS (SELECT id, si, list_sort(coalesce(list_distinct(list(coalesce(exact, first)) FILTER (outcome IN ('found', 'fell_back'))), [])) AS gold FROM res GROUP BY ALL),
every AS (SELECT id, si, count(*) AS refs, sum(length(raw)) AS ref_chars FROM refs GROUP BY ALL),
q AS (SELECT s.id, s.law_id, s.si, sentence, refs, ref_chars, gold, regexp_replace(regexp_replace(sentence, '{C.CITATION}', '', 'g'), '\\s+', '', 'g') AS text FROM sent s JOIN every USING (id, si) JOIN per_ref USING (id, si)),
cseg AS (SELECT id, {SEGMENTS} AS seg FROM chunks), cdf AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT chunk_idx, unnest({BIGRAMS}) AS term FROM (SELECT chunk_idx, {SEGMENTS} AS seg FROM chunks)) GROUP BY term),
qseg AS (SELECT *, {SEGMENTS} AS seg FROM q), qt AS (SELECT DISTINCT id, si, unnest({BIGRAMS}) AS term FROM qseg),
rare AS (SELECT id, si, count(*) AS rare FROM qt LEFT JOIN cdf USING (term) WHERE coalesce(df, 0) <= (SELECT count(*) FROM chunks) * {evalset.DF_SHARE} GROUP BY ALL),
judged AS (SELECT qseg.*, CASE WHEN refs > 3 THEN 'tooManyRefs' WHEN ref_chars / length(sentence) >= 0.3 THEN 'refCoverageTooHigh' WHEN len(gold) = 0 THEN '' WHEN len(gold) > 3 THEN 'tooManyGold' WHEN length(text) < 20 THEN 'queryTooShort'
    WHEN coalesce(list_sum([length(x) FOR x IN seg]), 0) < 25 THEN 'notSubstantive' WHEN coalesce(rare, 0) < 3 THEN 'notDistinctive' END AS reason FROM qseg LEFT JOIN rare USING (id, si)),
items AS (SELECT id || '@' || si AS item, id AS source, law_id, text AS query, gold FROM judged WHERE reason IS NULL)"""

LAWS = """base AS (SELECT p_partkey AS k, p_partkey % 20 AS law, CAST(p_partkey // 20 AS VARCHAR) AS article, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS caption, replace(p_name || 'は、' || p_brand || p_type, ' ', '') AS one, replace(p_brand, ' ', '') AS two FROM part),
heads AS (SELECT law, CASE WHEN law % 5 > 0 THEN 'L' || law END AS law_id, CASE WHEN law % 5 > 0 THEN 'N' ELSE '番号' END || law AS law_num, CASE WHEN law % 5 > 0 THEN 'T' ELSE '題' END || law AS title FROM (SELECT DISTINCT law FROM base)),
paras AS (SELECT k, law, article, caption, '1' AS paragraph, one AS text FROM base UNION ALL SELECT k, law, article, caption, '2', two FROM base WHERE k % 4 <> 0)"""
SQL = {
    "statute_files": f"""WITH {LAWS} SELECT law_id, law_num, title, article, caption, '第何条' AS label, '第一章　総則' AS chapter, CAST(NULL AS VARCHAR) AS section, paragraph, text, true AS in_main FROM paras JOIN heads USING (law)
        UNION ALL SELECT law_id, law_num, title, NULL, NULL, NULL, NULL, NULL, NULL, NULL, false FROM heads, range(2) WHERE law % 3 = 0""",
    "statute_articles": f"""WITH {LAWS}, a AS (SELECT law, article, caption, string_agg(text, '' ORDER BY paragraph) AS text FROM paras GROUP BY ALL)
        SELECT law_id || '#' || article || '-0' AS id, law_id, article, caption, '第一章　総則' AS chapter, text, coalesce(caption || '　', '') || text AS index_text FROM a JOIN heads USING (law) WHERE law_id IS NOT NULL""",
    "int_to_kanji": f"SELECT n, {kanji('n')} AS kanji FROM range(0, 10001) t(n)",
    "kanji_to_int": f"SELECT {kanji('n')} AS kanji, CASE WHEN n BETWEEN 1 AND 9999 THEN n END AS n FROM range(0, 10001) t(n)",
    "article_label": f"SELECT n, '第' || {kanji('n')} || '条' || CASE WHEN n % 3 = 0 THEN 'の' || {kanji('n % 7 + 1')} ELSE '' END AS label, n || CASE WHEN n % 3 = 0 THEN '_' || (n % 7 + 1) ELSE '' END AS number FROM range(1, 10000) t(n)",
    "statute_chunks": f"WITH {CHUNKS} SELECT * FROM chunks",
    "refs_extract": f"WITH {REFS} SELECT id, si, k, raw, start, article, paragraph, item, external FROM refs",
    "refs_mask": f"WITH {SENTENCES} SELECT id, si, regexp_replace(sentence, '{C.CITATION}', '', 'g') AS masked FROM sent",
    "refs_relative_counts": f"WITH {SENTENCES}, r AS (SELECT unnest(regexp_extract_all(sentence, '({'|'.join(C.RELATIVE)})')) AS pattern FROM sent) SELECT pattern, count(*) AS n FROM r GROUP BY pattern",
    "oracle_items": f"WITH {DERIVED} SELECT item, source, law_id, query, array_to_string(gold, ',') AS gold FROM items",
    "oracle_rejects": f"WITH {DERIVED} SELECT reason, count(*) AS n FROM judged WHERE reason IS NOT NULL AND reason <> '' GROUP BY reason",
    "oracle_reference_counts": f"WITH {DERIVED} SELECT outcome, count(*) AS n FROM (SELECT 'external' AS outcome FROM refs WHERE external UNION ALL SELECT outcome FROM res SEMI JOIN (SELECT * FROM judged WHERE reason IS NULL OR reason NOT IN ('tooManyRefs', 'refCoverageTooHigh')) j USING (id, si) WHERE outcome <> 'found') GROUP BY outcome",
    "granularity_compare": f"""WITH {DERIVED}, art AS (SELECT id, any_value(law_id || '#' || article) AS art FROM chunks GROUP BY id),
        g AS (SELECT item, list_distinct(list(art)) AS gold, count(*) FILTER (art IS NULL) AS lost FROM (SELECT item, unnest(gold) AS id FROM items) LEFT JOIN art USING (id) GROUP BY item),
        m AS (SELECT item, g.gold, CASE WHEN a.art IS NULL THEN 'sourceMissing' WHEN list_contains(g.gold, a.art) THEN 'selfArticle' WHEN coalesce(lost, 1) > 0 THEN 'goldMissing' ELSE 'kept' END AS outcome FROM items i JOIN g USING (item) LEFT JOIN art a ON a.id = i.source)
        SELECT outcome, count(*) AS n, CAST(sum(len(m.gold)) AS BIGINT) AS gold FROM m GROUP BY outcome""",
}
