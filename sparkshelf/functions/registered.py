"""Functions and a table function for SQL, the same as their Column forms."""

from __future__ import annotations

from pyspark.sql import SparkSession

from sparkshelf.functions.citations import CITATION, RELATIVE
from sparkshelf.functions.numerals import DIGITS, NUMERAL
from sparkshelf.functions.text import SEPARATORS, SPACE

_SEPARATORS = SEPARATORS.replace("\\", "\\\\")
_SPACE = SPACE.replace("\\", "\\\\")
_KANJI = "concat(" + ", ".join(f"CASE WHEN n div {v} % 10 > 1 THEN concat(substring('{DIGITS}', CAST(n div {v} % 10 AS INT), 1), '{u}') WHEN n div {v} % 10 = 1 THEN '{u}' ELSE '' END" for u, v in (("千", 1000), ("百", 100), ("十", 10))) + f", CASE WHEN n % 10 > 0 THEN substring('{DIGITS}', CAST(n % 10 AS INT), 1) ELSE '' END)"
_UNIT = "CASE c WHEN '千' THEN 1000 WHEN '百' THEN 100 WHEN '十' THEN 10 ELSE 0 END"
_STEP = f"(x, c) -> named_struct('t', x.t + greatest(x.d, 1) * {_UNIT}, 'd', CASE WHEN c IN ('千', '百', '十') THEN 0 ELSE instr('{DIGITS}', c) END)"

#: name: parameters, result, body.
FUNCTIONS = {
    "segments": ("t STRING", "ARRAY<STRING>", f"filter(split(t, '{_SEPARATORS}'), x -> x != '')"),
    "bigram_list": ("t STRING", "ARRAY<STRING>", "flatten(transform(segments(t), s -> CASE WHEN length(s) = 1 THEN array(s) ELSE transform(sequence(1, length(s) - 1), i -> substring(s, i, 2)) END))"),
    "bigrams": ("t STRING", "ARRAY<STRING>", "array_distinct(bigram_list(t))"),
    "token_length": ("t STRING", "BIGINT", "CAST(size(bigram_list(t)) AS BIGINT)"),
    "substantive_length": ("t STRING", "BIGINT", f"CAST(length(regexp_replace(t, '{_SEPARATORS}', '')) AS BIGINT)"),
    "without_space": ("t STRING", "STRING", f"regexp_replace(t, '[{_SPACE}]+', '')"),
    "int_to_kanji": ("n BIGINT", "STRING", f"CASE WHEN n BETWEEN 1 AND 9999 THEN {_KANJI} END"),
    "kanji_to_int": ("t STRING", "INT", f"CASE WHEN t RLIKE '^{NUMERAL}$' THEN aggregate(filter(split(t, ''), c -> c != ''), named_struct('t', 0, 'd', 0), {_STEP}, x -> x.t + x.d) END"),
    "citations_masked": ("t STRING", "STRING", f"regexp_replace(t, '{CITATION}', '')"),
    "relative_citations": ("t STRING", "ARRAY<STRING>", f"regexp_extract_all(t, '({'|'.join(RELATIVE)})', 1)"),
    "dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "round_half_away": ("x DOUBLE", "BIGINT", "CASE WHEN x >= 0 THEN floor(x + 0.5D) ELSE -floor(-x + 0.5D) END"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes them temporary functions of the session; their names, with that of the table function."""
    from sparkshelf.sources.statutes import LawParagraphs

    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udtf.register("law_paragraphs", LawParagraphs)
    return [*FUNCTIONS, "law_paragraphs"]
