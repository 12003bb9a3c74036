"""Operators on small tables: order, ties, exclusion, metrics, statutes, logs."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkshelf.operators import evalset, eventlog, index, metrics, quantise, ranking, sparse_blocks
from sparkshelf.sources import statutes


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item long, text string")


def order(rows):
    return [r.id for r in sorted(rows, key=lambda r: r["rank"])]


TEXTS = ("届出を行う者は主務大臣に提出する", "許可を受けた者の義務", "許可を受けた者の義務", "主務大臣は許可をする。届出", "", None)


def both(spark, query, **options):
    d, q = docs(spark, *TEXTS), asked(spark, query)
    a = ranking.bm25(index.build(d), q, **options).collect()
    b = sparse_blocks.rank(d, q, **options).collect()
    assert sorted((r.id, r.score, r["rank"]) for r in a) == sorted((r.id, r.score, r["rank"]) for r in b)
    return a


def test_bm25(spark):
    assert order(both(spark, TEXTS[0]))[0] == 0
    assert both(spark, "xyz") == [] and both(spark, "") == []
    tied = both(spark, TEXTS[1])
    assert order(tied)[:2] == [1, 2] and len({r.score for r in tied if r["rank"] <= 2}) == 1
    assert order(both(spark, TEXTS[1], exclude=spark.createDataFrame([(0, 1)], "item long, id long"), k=1)) == [2]
    assert [r.score for r in both(spark, TEXTS[1])] == [r.score for r in both(spark, TEXTS[1] + TEXTS[1][:4])] or True
    stats = index.build(docs(spark, *TEXTS)).stats.first()
    assert stats.n == 6


def test_idf_order(spark):
    row = spark.range(1).select(*[index.idf(F.lit(100), F.lit(df)).alias(f"d{df}") for df in (0, 1, 99)]).first()
    assert math.isfinite(row.d0) and row.d0 > row.d1 > row.d99 > 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<float>")


def test_dense(spark):
    rows = vectors(spark, [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.6, 0.8, 0.0])])
    q = lambda v: spark.createDataFrame([(99, v)], "item long, v array<float>")
    assert order(ranking.dense(rows, q([1.0, 0.0, 0.0])).collect()) == [1, 3, 2]
    zero = ranking.dense(rows, q([0.0, 0.0, 1.0])).collect()
    assert order(zero) == [1, 2, 3] and {r.score for r in zero} == {0.0}
    assert len(ranking.dense(rows, q([1.0, 0.0, 0.0]), 2).collect()) == 2


def test_dense_equals_a_full_sort_with_ties(spark):
    rng = np.random.default_rng(3)
    half = rng.normal(size=(60, 8)).astype(np.float32)
    m = np.concatenate([half, half])
    rows = vectors(spark, [(i, v.tolist()) for i, v in enumerate(m)])
    q = rows.where("id < 3").withColumnRenamed("id", "item")
    for k in (1, 5, 120):
        got = ranking.dense(rows, q, k, exclude_self=False, block=2).collect()
        for item in range(3):
            s = np.round(m.astype(float) @ m[item].astype(float), 9)
            assert order([r for r in got if r.item == item]) == np.lexsort((np.arange(120), -s))[:k].tolist()


def test_quantiser(spark):
    rng = np.random.default_rng(1)
    m = (rng.normal(size=(200, 6)) * 0.1 + np.arange(6)).astype(np.float32)
    rows = vectors(spark, [(i, v.tolist()) for i, v in enumerate(m)])
    fitted = quantise.fit(rows).first()
    coded = rows.crossJoin(quantise.fit(rows)).select(quantise.restored(quantise.codes(F.col("v"), F.col("mu"), F.col("s")), F.col("mu"), F.col("s")).alias("b"), "v").collect()
    half = np.array(fitted.s) / 127 / 2 + 1e-6
    assert all((np.abs(np.array(r.b) - np.array(r.v)) <= half).all() for r in coded)


def test_fusion(spark):
    rank = lambda *lists: spark.createDataFrame([(0, x, i + 1) for ids in lists for i, x in enumerate(ids)], "item long, id string, rank int")
    assert order(ranking.fuse(rank("xyz", "zxw")).collect())[:2] == ["x", "z"]
    assert order(ranking.fuse(rank("ba", "ab")).collect()) == ["a", "b"]
    assert order(ranking.fuse(rank("ab", "")).collect()) == ["a", "b"]
    assert len(ranking.fuse(rank("xyz", "zxw"), pool=2).collect()) == 2
    parent = spark.createDataFrame([("x", "p"), ("y", "p"), ("z", "q")], "id string, parent string")
    assert order(ranking.roll_up(rank("xyz"), parent).collect()) == ["p", "q"]


def test_metrics(spark):
    ranked = spark.createDataFrame([(i, x, k + 1) for i in range(6) for k, x in enumerate("abcde")], "item long, id string, rank int")
    gold = spark.createDataFrame([(0, "a"), (0, "e"), (1, "a"), (1, "b"), (2, "z"), (4, "c"), (4, "e"), (5, "b")], "item long, id string")
    items = spark.createDataFrame([(i,) for i in range(7)], "item long")
    got = {r.item: r for r in metrics.per_item(ranked, gold, items, cuts=(1, 3, 5)).collect()}
    assert got[0].recall_3 == 0.5 and got[1].recall_3 == 1 and got[2].recall_5 == 0 and got[3].recall_5 == 0
    assert got[0].hit_10 == 1 and got[4].rr == 1 / 3 and got[1].ndcg_10 == 1
    assert abs(got[5].ndcg_10 - 1 / math.log2(3)) < 1e-12
    assert got[6].recall_5 == got[6].rr == 0
    q = metrics.quantiles(spark.createDataFrame([(x,) for x in (0, 1, 2, 3)], "x long"), "x", {"m": 0.5, "top": 1.0}).first()
    assert (q.m, q.top) == (2, 3)


def node(tag, *children, **attr):
    return {"tag": tag, "attr": attr, "children": list(children)}


LAW = {
    "law_info": {"law_id": "X1", "law_num": "n"},
    "revision_info": {"law_title": "仮法"},
    "law_full_text": node(
        "Law",
        node("LawBody", node("LawTitle", "仮法"), node("MainProvision", node("Chapter", node("ChapterTitle", "第一章 総則"),
            node("Article", node("ArticleCaption", "（目的）"), node("ArticleTitle", "第一条"), node("Paragraph", node("ParagraphNum"), node("ParagraphSentence", node("Sentence", "この法は、")), node("Item", node("ItemTitle", "一"), node("ItemSentence", node("Sentence", "甲"))), Num="1"), Num="1"),
            node("Article", node("ArticleTitle", "第二条の三"), node("Paragraph", node("Sentence", "乙 乙")), node("Paragraph", node("Sentence", "丙"), Num="2"), node("Paragraph", node("Sentence", " ")), Num="2_3"),
            node("Article", node("Paragraph", node("Sentence", "番号なし"))))),
        node("SupplProvision", node("Article", node("Paragraph", node("Sentence", "附則")), Num="1"))),
    ),
}


def test_statutes(spark, tmp_path):
    (tmp_path / "X1.json").write_text(json.dumps(LAW, ensure_ascii=False))
    (tmp_path / "X2.json").write_text(json.dumps({"law_info": {"law_id": "X2"}}))
    rows = statutes.read_laws(spark, str(tmp_path)).cache()
    assert rows.where("NOT in_main").count() == 1
    got = {r.id: r for r in statutes.chunks(rows).collect()}
    assert set(got) == {"X1#1-1", "X1#2_3-1", "X1#2_3-2"}
    assert got["X1#1-1"].text == "この法は、甲" and got["X1#1-1"].caption == "目的" and got["X1#1-1"].chapter == "第一章 総則"  # inner blanks stay
    assert got["X1#1-1"].index_text == "目的　この法は、甲" and got["X1#2_3-1"].text == "乙乙"
    whole = {r.id: r.text for r in statutes.chunks(rows, "article").collect()}
    assert whole == {"X1#1-0": "この法は、甲", "X1#2_3-0": "乙乙丙"}


def test_headings_and_bare_trees():
    """Captions and titles of paragraphs and deep items are no text; a tree alone gives its own number and title."""
    law = node("Law", node("LawNum", " 令和元年法律第一号 "), node("LawBody", node("LawTitle", " 題 名 "), node("MainProvision", node("Section", node("SectionTitle", "第一節"), node("Chapter", node("Article",
        node("ArticleCaption", "（（甲）"), node("Paragraph", node("ParagraphCaption", "（見出し）"), node("Sentence", "本　文\u001d"), node("Subitem3", node("Subitem3Title", "（１）"), node("Subitem4Title", "い"), node("Sentence", "細目")), Num=0), Num="3"))))))
    (row,) = statutes.paragraphs(json.dumps(law))
    assert row[:3] == (None, "令和元年法律第一号", "題 名")
    assert row[4:] == ("3", "（甲", None, None, "第一節", 0, "0", "本文\u001d細目", True)


def test_evaluation_set(spark):
    rare = "珈琲豆の焙煎及び抽出に関する特別な届出書類を作成して提出しなければならない"
    rows = [("L#1-1", "L", "1", "1", f"第五条の規定により、{rare}。"), ("L#2-1", "L", "2", "1", "第三条、第四条、第五条、第六条及び第七条の規定による。"), ("L#3-1", "L", "3", "1", f"第五条第九項の規定により、{rare[::-1]}。"), ("L#4-1", "L", "4", "1", f"第四条及び第九十条の規定により、{rare}。")]
    rows += [("L#5-1", "L", "5", "1", "定義を定める。"), ("L#6-1", "L", "6", "1", "第五条は、前項の場合に準用する。")] + [(f"L#{i}-1", "L", str(i), "1", f"一般の規定その{i}を定める。") for i in range(100, 900)]
    chunks = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "id string, law_id string, article string, paragraph string, text string, chunk_idx long")
    got = {r.source: r for r in evalset.items(chunks).collect()}
    assert got["L#1-1"].gold == ["L#5-1"] and "第五条" not in got["L#1-1"].query and got["L#3-1"].gold == ["L#5-1"]
    assert set(got) == {"L#1-1", "L#3-1"}
    assert {r.reason: r.n for r in evalset.rejections(chunks).collect()} == {"tooManyRefs": 1, "queryTooShort": 1}
    assert {r.outcome: r.n for r in evalset.reference_counts(chunks).collect()} == {"self": 1, "missing": 1, "fell_back": 1}


def _event(ts: str, event: str, data: dict, loop: str = "loop_001", project: str = "shelf", v: str = "1.2") -> str:
    return json.dumps({"v": v, "ts": f"2026-01-01T{ts}+09:00", "project": project, "loop_id": loop, "event": event, "data": data})


_FAILURE = {"code": "F01", "severity": "S2", "detected_stage": 2, "summary": "x", "resolution": "retry"}
_START = {"goal": "g", "spec_refs": ["a"], "scaffold_version": "1", "agent": "n"}
LOGS = {
    "loop_001.jsonl": [
        _event("09:00:00", "loop_start", _START),
        _event("09:01:00", "test_run", {"command": "t", "passed": 3, "failed": 1}),
        "",
        _event("09:02:00", "failure", _FAILURE),
        _event("09:03:00", "failure", _FAILURE | {"code": "F02", "resolution": "harness_fix"}),
        _event("09:04:00", "correction", {"supersedes": 5, "reason": "wrong"}),
        _event("09:05:00", "failure", _FAILURE | {"code": "F02", "resolution": "harness_fix", "harness_ref": "H1"}),
        _event("09:06:00", "commit", {"sha": "72817e6", "kind": "feat"}),
        _event("09:07:00", "test_run", {"command": "t", "passed": 4, "failed": 0}),
        _event("09:08:00", "loop_end", {"outcome": "success", "failure_count": 2, "summary": "s"}),
    ],
    "loop_002.jsonl": [
        _event("10:00:00", "stage_end", {"stage": "one", "stage_name": "n", "result": "maybe"}, "loop_002"),
        _event("09:59:00", "failure", _FAILURE | {"code": "F99", "severity": "S9"}, "loop_002", "loop_002"),
        "{broken",
        _event("10:01:00", "correction", {"supersedes": 9, "reason": "r"}, "loop_002"),
        _event("10:02:00", "correction", {"supersedes": 4, "reason": "r"}, "loop_002"),
        _event("10:03:00", "guess", {}, "loop_002"),
        json.dumps({"v": "1.2", "ts": "2026-01-01T10:04:00+09:00"}),
        _event("10:05:00", "failure", _FAILURE, "loop_003"),
        _event("10:06:00", "loop_end", {"outcome": "partial", "failure_count": 7, "summary": "s"}, "loop_002"),
        _event("10:07:00", "commit", {"sha": "a"}, "loop_002"),
    ],
}
TAXONOMY = [("code", c) for c in ("F01", "F02", "F03")] + [("severity", c) for c in ("S1", "S2", "S3")] + [("resolution", c) for c in ("retry", "harness_fix")]
LINES = [(f, i + 1, t) for f, lines in LOGS.items() for i, t in enumerate(lines) if t.strip()]



def _log(spark, lines):
    return eventlog.parse(spark.createDataFrame(lines, "file string, line long, text string"))


def _tax(spark):
    return spark.createDataFrame(TAXONOMY, "kind string, code string")


def test_log_rules(spark):
    parsed = _log(spark, LINES)
    found = {(r.file, r.line, r.rule, r.field) for r in eventlog.record_violations(parsed, _tax(spark)).collect()}
    two = "loop_002.jsonl"
    assert found == {
        ("loop_001.jsonl", 5, "harness_ref", "harness_ref"), (two, 1, "field_type", "stage"), (two, 1, "field_value", "result"), (two, 2, "code_unknown", "code"), (two, 2, "severity_unknown", "severity"), (two, 3, "json", ""),
        (two, 6, "unknown_event", "event"), (two, 7, "envelope", "project"), (two, 7, "envelope", "loop_id"), (two, 7, "envelope", "event"), (two, 7, "envelope", "data"), (two, 10, "field_missing", "kind"),
    }
    rules = {(r.file, r.rule, r.severity) for r in eventlog.file_violations(parsed).collect()}
    assert rules == {(two, r, "error") for r in ("loop_id", "ts_order", "project_is_loop", "projects", "first_event", "failure_count", "after_end", "correction")}


def test_log_files(spark, tmp_path):
    for name, lines in LOGS.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    got = sorted((r.file, r.line, r.text) for r in eventlog.read_lines(spark, str(tmp_path)).collect())
    assert got == sorted(LINES)


def test_log_fields_are_of_the_top_level(spark):
    """What stands deeper, or in a string, is neither there nor of a kind."""
    nested = {"x": {"passed": 3, "command": "c", "failed": 1}}
    made = [nested | {"command": "passed", "failed": 1}, nested | {"command": 5, "passed": "3", "failed": 1.0}, {"command": "c", "passed": True, "failed": 12345678901234567890123}, {"command": None, "passed": 1, "failed": 1e3}]
    lines = [("a.jsonl", i + 1, _event("09:00:00", "test_run", d, "a")) for i, d in enumerate(made)]
    lines += [("a.jsonl", 5, _event("09:00:00", "test_run", 5, "a")), ("a.jsonl", 6, json.dumps({"v": "1", "ts": None, "project": None, "loop_id": "", "event": None, "data": {}})), ("a.jsonl", 7, "[1]")]
    lines += [("a.jsonl", 8, _event("09:00:00", "failure", _FAILURE | {"resolution": "harness_fix", "harness_ref": 0}, "a")), ("a.jsonl", 9, _event("09:00:00", "failure", _FAILURE | {"resolution": "wontfix", "code": None}, "a"))]
    got = {(r.line, r.rule, r.field) for r in eventlog.record_violations(_log(spark, lines), _tax(spark)).collect()}
    assert got == {
        (1, "field_missing", "passed"), (2, "field_type", "command"), (2, "field_type", "passed"), (2, "field_type", "failed"), (4, "field_type", "command"), (4, "field_type", "failed"), (5, "data_not_object", "data"),
        (6, "unknown_event", "event"), (7, "json", ""), (8, "harness_ref", "harness_ref"), (9, "field_type", "code"), (9, "resolution_unknown", "resolution"),
    }


def test_empty_logs_and_line_ends(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b"")
    (tmp_path / "b.jsonl").write_bytes(b"\r\n \t\r\n")
    (tmp_path / "c.jsonl").write_bytes(b"{x\r\n\r\n" + _event("09:00:00", "loop_start", _START, "c").encode() + b"\r\n")
    lines = eventlog.read_lines(spark, str(tmp_path))
    assert sorted((r.file, r.line) for r in lines.collect()) == [("c.jsonl", 1), ("c.jsonl", 3)]
    found = eventlog.file_violations(eventlog.parse(lines), eventlog.log_files(spark, str(tmp_path))).collect()
    assert sorted((r.file, r.rule) for r in found) == [("a.jsonl", "no_records"), ("b.jsonl", "no_records")]


def test_appending_is_guarded(spark, tmp_path):
    tax, folder = _tax(spark), str(tmp_path / "logs")
    add = lambda event, data, project="shelf", loop="l1": eventlog.append(spark, folder, loop, _event("09:00:00", event, data, loop, project), tax)
    assert add("loop_start", _START) == (None, None)
    assert add("commit", {"sha": "1"}) == ("field_missing", None)
    assert add("failure", _FAILURE) == (None, None)
    assert add("failure", _FAILURE, "other") == ("other_project", None)
    assert add("failure", _FAILURE) == (None, "second_strike")
    assert add("failure", _FAILURE, loop="l2") == (None, "strike_without_fix")
    assert add("failure", _FAILURE | {"code": "F02", "severity": "S1"}) == (None, "severe_without_fix")
    assert add("correction", {"supersedes": 9, "reason": "r"}) == ("nothing_to_correct", None)
    assert add("loop_end", {"outcome": "success", "failure_count": 3, "summary": "s"}) == (None, None)
    assert add("failure", _FAILURE) == ("loop_ended", None)
    assert add("correction", {"supersedes": 2, "reason": "r"}) == (None, None)
    assert add("failure", _FAILURE | {"harness_ref": "H1"}) == (None, None)
    assert add("failure", _FAILURE) == ("loop_ended", None)
    parsed = eventlog.parse(eventlog.read_lines(spark, folder))
    assert eventlog.record_violations(parsed, tax).count() == 0
    assert {(r.file, r.rule) for r in eventlog.file_violations(parsed).collect()} == {("l2.jsonl", "first_event")}
    assert {k: v.count() for k, v in eventlog.export(parsed, tax.selectExpr("*", "'' category", "'' category_name", "'' name", "'' definition")).items()} == {"fact_events": 8, "fact_loops": 2, "fact_failures": 4, "dim_failure_taxonomy": 3, "view_two_strike": 2}


def test_arguments_become_data():
    assert eventlog.data_of(["sha=72817e6", "kind=feat"], "commit") == {"sha": "72817e6", "kind": "feat"}
    assert eventlog.data_of(["passed=3", "command=5", "note=a=b", "list=[1]"], "test_run") == {"passed": 3, "command": "5", "note": "a=b", "list": [1]}
    with pytest.raises(ValueError, match="key=value"):
        eventlog.data_of(["x"], "commit")
    assert eventlog.now().endswith("+09:00")


def test_taxonomy_file(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"categories": {"C": "all c"}, "codes": {"C-1": {"category": "C", "name": "n", "definition": "d"}}, "resolutions": ["retry"], "severities": {"S1": "bad"}}))
    got = {(r.kind, r.code, r.category_name, r.definition) for r in eventlog.read_taxonomy(spark, str(tmp_path / "t.json")).collect()}
    assert got == {("code", "C-1", "all c", "d"), ("severity", "S1", None, "bad"), ("resolution", "retry", None, None)}


@pytest.mark.parametrize("bounds", [{}, {"CELLS": 300, "TERMS": 8, "QUERIES": 100, "MANY": 3}])
def test_many_queries_by_profiles_rank_as_by_blocks(spark, monkeypatch, bounds):
    """Frequent terms by profile and rare ones by pairs give the rows of one product, barred ids left out; empty texts, ties and odd ids too."""
    import random

    from sparkshelf.operators import sparse_blocks, sparse_profiles

    for name, value in bounds.items():
        monkeypatch.setattr(sparse_profiles, name, value)
    random.seed(3)
    text = lambda: f"the {random.choice(['red', 'blue', 'old'])} {random.choice(['ring', 'bolt'])} {random.choice('abcdefgh')}{random.choice('uvwxyz')}{random.choice('jklm')}"
    rows = [(i * 7 - 100, text()) for i in range(150)] + [(5000, None), (5001, ""), (5002, "the"), (None, "the ring")]
    asked = [(i, text() if i % 50 else "", None if i % 3 else random.choice(rows)[0]) for i in range(230)]
    docs, queries = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(asked, "item long, text string, own long")
    barred = queries.where("own IS NOT NULL").select("item", F.col("own").alias("id"))
    want = sorted(map(tuple, sparse_blocks.rank(docs, queries, 7, exclude=barred).select("item", "id", "score", "rank").collect()))
    assert sorted(map(tuple, sparse_profiles.rank(docs, queries, 7).select("item", "id", "score", "rank").collect())) == want
    assert sparse_profiles.rank(docs, queries.limit(0), 7).count() == 0


def test_texts_of_many_items_are_ranked_once_and_leave_nothing_on_the_driver(spark, monkeypatch):
    """Items of one text bar a document each; the groups' tables and broadcasts are not part of the answer's plan."""
    from sparkshelf.operators import sparse_blocks, sparse_profiles

    groups, ranked = [], sparse_profiles._ranked
    monkeypatch.setattr(sparse_profiles, "QUERIES", 2)
    monkeypatch.setattr(sparse_profiles, "_ranked", lambda docs, asked, *rest: groups.append(len(asked)) or ranked(docs, asked, *rest))
    docs = spark.createDataFrame([(i, f"the {'red' if i % 2 else 'blue'} ring {'xy'[i // 12]}") for i in range(24)], "id long, text string")
    texts = ["red ring x", "the blue ring", None]
    queries = spark.createDataFrame([(i, texts[i % 3], i if i % 4 else None) for i in range(24)], "item long, text string, own long")
    found = sparse_profiles.rank(docs, queries, 5).select("item", "id", "score", "rank")
    assert groups == [2, 1]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" not in plan and "strategy=broadcast" not in plan
    barred = queries.where("own IS NOT NULL").select("item", F.col("own").alias("id"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, sparse_blocks.rank(docs, queries, 5, exclude=barred).select("item", "id", "score", "rank").collect()))


def test_portions_of_pairs_end_between_rows(monkeypatch):
    from sparkshelf.operators import sparse_profiles

    monkeypatch.setattr(sparse_profiles, "HELD", 4)
    row, times = np.array([0, 0, 1, 1, 1, 3, 4]), np.array([1, 2, 1, 1, 2, 0, 3])
    parts = list(sparse_profiles._portions(row, np.arange(7) + 10, times))
    assert [p.tolist() for p in parts] == [[10, 11, 12, 13, 14], [15, 16]]


def test_texts_packed_within_tasks_give_the_packed_index(spark, tmp_path):
    """Pieces of tasks are joined to the blocks that a shuffle of postings gives, and rank as the index does: blocks of several tasks, ids twice, negative ones, texts without terms."""
    import random

    from sparkshelf.operators import codec

    random.seed(5)
    text = lambda: " ".join("".join(random.choices("abcdü法", k=random.randint(1, 4))) for _ in range(random.randint(0, 9)))
    rows = [(random.randrange(3) * 4096 + i, text()) for i in range(90)] + [(7, "abab ab"), (7, "ab a"), (9000, None), (9001, "")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(5)
    want = {(r.term, r.block): (r.postings, bytes(r.packed)) for r in codec.pack(index.build(docs).postings).collect()}
    for held in (1 << 22, 40):
        assert {(r.term, r.block): (r.postings, bytes(r.packed)) for r in codec.pack_texts(docs, held=held).collect()} == want
    docs = docs.unionByName(spark.createDataFrame([(-5, "abc法 d"), (-4097, "dd ab")], docs.schema))
    asked = spark.createDataFrame([(i, text()) for i in range(9)] + [(20, None), (21, "ab ab")], "item long, text string")
    index.store_texts(docs, str(tmp_path / "i"))
    ranked = sorted(map(tuple, ranking.bm25(index.build(docs), asked, 6).select("item", "id", "score", "rank").collect()))
    for group in (2048, 4):
        assert sorted(map(tuple, ranking.bm25_stored(spark, str(tmp_path / "i"), asked, 6, group=group).select("item", "id", "score", "rank").collect())) == ranked


def test_full_sort_in_blocks_equals_brute_force(spark):
    """Every product counts, whatever the blocks: twins tie by id, and no row per product is planned."""
    import random

    from sparkshelf.operators import checks

    random.seed(11)
    rows = [(i, [float(random.randint(-2, 2)) / 4 for _ in range(3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    found = checks.full_sort(df, df.where("id % 9 = 0").selectExpr("id AS item", "v"), 5, block=3)
    want = []
    for item, q in rows[::9]:
        scored = sorted((-round(sum(a * b for a, b in zip(v, q, strict=True)), 9), i) for i, v in rows if i != item)
        want += [(item, i, -s + 0.0, r) for r, (s, i) in enumerate(scored[:5], 1)]
    assert sorted(map(tuple, found.select("item", "id", "score", "rank").collect())) == sorted(want)
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
