"""Queries on text scalars, chunks and the inverted index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkshelf.functions import text as T
from sparkshelf.operators import index
from sparkshelf.operators.chunks import document_chunks, line_chunks, length_stats, stats_by_source
from sparkshelf.operators.hygiene import SECRETS, hygiene, secret_catalogue
from sparkshelf.session import table

SEGMENTS = f"[x FOR x IN regexp_split_to_array(text, '{T.SEPARATORS}') IF x <> '']"
BIGRAMS = "flatten([CASE WHEN length(g) = 1 THEN [g] ELSE [substr(g, CAST(i AS BIGINT), 2) FOR i IN range(1, length(g))] END FOR g IN seg])"
#: Index of documents for DuckDB: seg, toks, postings, lengths, stats, dfs.
INDEX = f"""seg AS (SELECT doc_id AS id, {SEGMENTS} AS seg FROM documents),
toks AS (SELECT id, seg, {BIGRAMS} AS b FROM seg),
postings AS (SELECT id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT id, unnest(b) AS term FROM toks) GROUP BY ALL),
lengths AS (SELECT id, CAST(len(b) AS BIGINT) AS dl FROM toks),
stats AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(dl) AS DOUBLE) / count(*) AS avgdl FROM lengths),
dfs AS (SELECT term, CAST(count(*) AS BIGINT) AS df FROM postings GROUP BY term)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _index(spark: SparkSession, sf_dir: str) -> index.Index:
    return index.build(documents(spark, sf_dir), "doc_id")


def tok_segments(spark, sf_dir):
    seg = T.segments("text")
    return documents(spark, sf_dir).select("doc_id", F.size(seg).cast("long").alias("n_segments"), F.md5(F.array_join(seg, "|")).alias("digest"))


def tok_lengths(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("doc_id", T.substantive_length("text").alias("substantive"), T.token_length("text").alias("tokens"), F.size(T.bigrams("text")).cast("long").alias("distinct_bigrams"))


def tok_bigrams(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(F.array_join(T.bigrams("text"), "|")).alias("digest"))


def sentence_split(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("s", T.sentences(F.translate("text", ".", "。")))
    return d.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("digest"))


def space_removal(spark, sf_dir):
    stripped = T.without_space("text")
    return documents(spark, sf_dir).select("doc_id", F.length(stripped).cast("long").alias("n_chars"), T.short_hash(stripped).alias("digest"))


def postings_tf(spark, sf_dir):
    return _index(spark, sf_dir).postings.select(F.col("id").alias("doc_id"), "term", "tf")


def doc_freq(spark, sf_dir):
    return index.document_frequency(_index(spark, sf_dir).postings)


def corpus_stats(spark, sf_dir):
    return _index(spark, sf_dir).stats.select("n", F.round("avgdl", 9).alias("avgdl"))


def postings_delta(spark, sf_dir):
    return index.deltas(_index(spark, sf_dir).postings)


def index_fingerprint(spark, sf_dir):
    return index.fingerprint(_index(spark, sf_dir))


def chunk_docs(spark, sf_dir):
    return document_chunks(documents(spark, sf_dir)).select("id", "source", F.length("index_text").cast("long").alias("n"), T.short_hash(F.col("index_text")).alias("digest"))


def chunk_lines(spark, sf_dir):
    return line_chunks(documents(spark, sf_dir)).select("id", "source", "line", F.length("text").cast("long").alias("n"), T.short_hash(F.col("text")).alias("digest"))


def chunk_stats(spark, sf_dir):
    return stats_by_source(line_chunks(documents(spark, sf_dir)))


def chunk_length_stats(spark, sf_dir):
    return length_stats(line_chunks(documents(spark, sf_dir)))


def hygiene_scan(spark, sf_dir):
    return hygiene(documents(spark, sf_dir))


def secret_scan(spark, sf_dir):
    return secret_catalogue(documents(spark, sf_dir))


def highlight(spark, sf_dir):
    marked = T.highlight(F.col("text"), ["of the", "the", "und", "de la", "x"])
    return documents(spark, sf_dir).select("doc_id", T.short_hash(marked).alias("digest"), ((F.length(marked) - F.length("text")) / 13).cast("long").alias("marks"))


QUERIES = [tok_segments, tok_lengths, tok_bigrams, sentence_split, space_removal, postings_tf, doc_freq, corpus_stats, postings_delta, index_fingerprint, chunk_docs, chunk_lines, chunk_stats, chunk_length_stats, hygiene_scan, secret_scan, highlight]

LINES = """docs AS (SELECT doc_id, lang, source, text, [x FOR x IN string_split(text, chr(10))] AS l FROM documents),
numbered AS (SELECT doc_id, lang, source, unnest(l) AS text, unnest(range(1, len(l) + 1)) AS line FROM docs),
lines AS (SELECT source || '#' || doc_id || '-' || line AS id, doc_id, lang, source, CAST(line AS BIGINT) AS line, text FROM numbered WHERE length(text) > 0)"""

SQL = {
    "tok_segments": f"WITH s AS (SELECT doc_id, {SEGMENTS} AS seg FROM documents) SELECT doc_id, CAST(len(seg) AS BIGINT) AS n_segments, md5(array_to_string(seg, '|')) AS digest FROM s",
    "tok_lengths": f"WITH {INDEX} SELECT id AS doc_id, CAST(coalesce(list_sum([length(g) FOR g IN seg]), 0) AS BIGINT) AS substantive, CAST(len(b) AS BIGINT) AS tokens, CAST(len(list_distinct(b)) AS BIGINT) AS distinct_bigrams FROM toks",
    "tok_bigrams": f"""WITH {INDEX}, u AS (SELECT id, unnest(b) AS term, unnest(range(len(b))) AS p FROM toks),
        f AS (SELECT id, term, min(p) AS p FROM u GROUP BY ALL),
        j AS (SELECT id, string_agg(term, '|' ORDER BY p) AS t FROM f GROUP BY id)
        SELECT toks.id AS doc_id, md5(coalesce(t, '')) AS digest FROM toks LEFT JOIN j USING (id)""",
    "sentence_split": "WITH s AS (SELECT doc_id, [y FOR y IN [regexp_replace(x, '^\\s+|\\s+$', '', 'g') FOR x IN regexp_extract_all(translate(text, '.', '。'), '[^。]*。|[^。]+$')] IF y <> ''] AS s FROM documents) SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, md5(array_to_string(s, '|')) AS digest FROM s",
    "space_removal": f"WITH s AS (SELECT doc_id, regexp_replace(text, '[{T.SPACE}]+', '', 'g') AS t FROM documents) SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, substr(sha256(t), 1, 16) AS digest FROM s",
    "postings_tf": f"WITH {INDEX} SELECT id AS doc_id, term, tf FROM postings",
    "doc_freq": f"WITH {INDEX} SELECT term, df FROM dfs",
    "corpus_stats": f"WITH {INDEX} SELECT n, round(avgdl, 9) AS avgdl FROM stats",
    "postings_delta": f"WITH {INDEX} SELECT term, id, tf, id - lag(id, 1, 0) OVER (PARTITION BY term ORDER BY id) AS gap FROM postings",
    "index_fingerprint": f"""WITH {INDEX} SELECT stats.n, CAST(count(*) AS BIGINT) AS terms, CAST((SELECT sum(dl) FROM lengths) AS BIGINT) AS dl_sum,
        substr(sha256(string_agg(term, ',' ORDER BY term)), 1, 16) AS terms_hash, substr(sha256(string_agg(CAST(df AS VARCHAR), ',' ORDER BY term)), 1, 16) AS df_hash FROM dfs, stats GROUP BY stats.n""",
    "chunk_docs": "SELECT source || '#' || doc_id || '-0' AS id, source, CAST(length(lang || chr(12288) || text) AS BIGINT) AS n, substr(sha256(lang || chr(12288) || text), 1, 16) AS digest FROM documents WHERE length(text) > 0",
    "chunk_lines": f"WITH {LINES} SELECT id, source, line, CAST(length(text) AS BIGINT) AS n, substr(sha256(text), 1, 16) AS digest FROM lines",
    "chunk_stats": f"WITH {LINES} SELECT source, CAST(count(*) AS BIGINT) AS chunks, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars FROM lines GROUP BY ROLLUP (source)",
    "chunk_length_stats": f"""WITH {LINES}, r AS (SELECT length(text) AS n, row_number() OVER (ORDER BY length(text)) - 1 AS k, count(*) OVER () AS c FROM lines)
        SELECT {", ".join(f"CAST(max(CASE WHEN k = least(CAST(floor(c * {s}) AS BIGINT), c - 1) THEN n END) AS BIGINT) AS {name}" for name, s in (("min", 0.0), ("p50", 0.5), ("p90", 0.9), ("max", 1.0)))} FROM r""",
    "hygiene_scan": f"""WITH {LINES}, v AS (SELECT doc_id, line, kind FROM lines, (VALUES {", ".join(f"('{k}', '{r}')" for k, r in T.FOREIGN.items())}) t(kind, re) WHERE NOT contains(text, '{T.ALLOW_MARK}') AND regexp_matches(text, re))
        SELECT kind, CAST(count(*) AS BIGINT) AS lines, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs FROM v GROUP BY kind""",
    "secret_scan": f"""WITH {LINES}, v AS (SELECT doc_id, line, rule, level FROM lines, (VALUES {", ".join(f"('{k}', '{lv}', '{r}')" for k, lv, r in SECRETS)}) t(rule, level, re) WHERE regexp_matches(text, re))
        SELECT rule, level, CAST(count(*) AS BIGINT) AS lines, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs FROM v GROUP BY ALL""",
    "highlight": "WITH m AS (SELECT doc_id, text, regexp_replace(text, '(of the|the|und|de la)', '<mark>\\1</mark>', 'g') AS t FROM documents) SELECT doc_id, substr(sha256(t), 1, 16) AS digest, CAST((length(t) - length(text)) // 13 AS BIGINT) AS marks FROM m",
}
