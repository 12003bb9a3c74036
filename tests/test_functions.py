"""Hand-computed cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from sparkshelf.functions import citations as C
from sparkshelf.functions import numerals as N
from sparkshelf.functions import text as T
from sparkshelf.operators.evalset import mulberry32, seeded_places
from sparkshelf.operators.quantise import round_half_away


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text, want", [("あい、うえ", ["あい", "うえ"]), ("あいうえ", ["あい", "いう", "うえ"]), ("あ、いう", ["あ", "いう"]), ("a　b", ["a", "b"]), ("a b﻿c", ["a", "b", "c"]), ("、。", []), ("", []), ("ababab", ["ab", "ba"])])
def test_bigrams(spark, text, want):
    assert one(spark, text, T.bigrams) == want


def test_lengths(spark):
    assert one(spark, "あいうえお", T.substantive_length) == 5
    assert one(spark, "あい、う。", T.token_length) == 2
    assert one(spark, "ab ab", T.token_length) == len(one(spark, "ab ab", T.bigram_list)) == 2


def test_sentences(spark):
    assert one(spark, " 甲は乙。　丙は丁。戊", T.sentences) == ["甲は乙。", "丙は丁。", "戊"]
    assert "".join(one(spark, "一。二。", T.sentences)) == "一。二。"


@pytest.mark.parametrize("text, n", [("一", 1), ("十", 10), ("百二十", 120), ("千", 1000), ("九千九百九十九", 9999), ("一二", 2), ("", None), ("x", None)])
def test_kanji(spark, text, n):
    assert one(spark, text, N.kanji_to_int) == n


@pytest.mark.parametrize("label, number", [("第十七条", "17"), ("第四条の二", "4_2"), ("第百二十条の二", "120_2"), ("第九条の二の三", "9_2_3")])
def test_labels(spark, label, number):
    assert one(spark, label, N.label_to_number) == number
    assert one(spark, number, N.number_to_label) == label


def test_no_label(spark):
    assert one(spark, "第条", N.label_to_number) is None
    assert one(spark, 0, N.int_to_kanji, "int") is None
    assert one(spark, 10000, N.int_to_kanji, "int") is None


def refs(spark, text, **options):
    return [(r.raw, r.start, r.end, r.article, r.paragraph, r.item) for r in one(spark, text, lambda x: C.citations(x, **options))]


def test_citations(spark):
    assert refs(spark, "前文第五条第二項第三号及び第四条の二の規定") == [("第五条第二項第三号", 2, 11, "5", "2", "3"), ("第四条の二", 13, 18, "4_2", None, None)]
    assert refs(spark, "第五条") == []  # a title
    assert refs(spark, "民法第七百九条の規定") == []
    assert refs(spark, "民法（明治二十九年法律第八十九号）第七百九条の規定") == []
    assert len(refs(spark, "民法第七百九条の規定", include_external=True)) == 1
    assert refs(spark, "三条の件") == []


def test_relative_and_masked(spark):
    assert one(spark, "前各項及び前条、同法同条", C.relative_counts) == ["前各項", "前条", "同法", "同条"]
    assert one(spark, "民法第七百九条及び第二条第一項の規定", C.masked) == "民法及びの規定"


@pytest.mark.parametrize("x, want", [(0.5, 1), (-0.5, -1), (1.5, 2), (2.5, 3), (-2.5, -3), (0.4, 0), (0.49999999999999994, 1)])
def test_rounding(spark, x, want):
    assert one(spark, x, round_half_away, "double") == want


def test_hygiene(spark):
    assert one(spark, "abc Ж 한 \x01", T.violations) == ["cyrillic", "hangul", "control"]
    assert one(spark, "abc Ж text-hygiene:allow", T.violations) == []
    assert one(spark, "plain\ttext", T.violations) == []


def test_highlight_and_versions(spark):
    assert one(spark, "abc ab", lambda x: T.highlight(x, ["ab", "abc", "c"])) == "<mark>ab</mark>c <mark>ab</mark>"
    assert one(spark, "（見出し）", T.strip_caption) == "見出し"
    for v, want in (("1.2", True), ("1.10", True), ("1.1", False), ("2", True), ("x", False), (None, False)):
        assert one(spark, v, lambda x: T.version_at_least(x, 1, 2)) is want


def test_seeded_sample():
    a = mulberry32(1)
    first = [next(a) for _ in range(5)]
    b = mulberry32(1)
    assert first == [next(b) for _ in range(5)] and all(0 <= x < 1 for x in first)
    places = seeded_places(100, 10, 7)
    assert places == sorted(set(places)) and len(places) == 10 and places == seeded_places(100, 10, 7)
