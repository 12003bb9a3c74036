"""Files, landing, stored tables, streams and the small functions that no registered query reaches."""

import json

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkshelf.functions import text as T
from sparkshelf.operators import checks, eventlog, evalpack, index, quantise, ranking, sinks, sparse_blocks
from sparkshelf.sources import files
from sparkshelf.streaming import events as streams


def test_text_tree(spark, tmp_path):
    root = tmp_path / "a tree"
    for name in ("one.md", "two.py", "three.bin", "deep/four.txt", "node_modules/five.md", "deep/dist/six.md", "seven skip.md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"{name}\nx")
    (tmp_path / "ignore").write_text("# none\n\n skip \n")
    ignores = files.read_ignores(spark, str(tmp_path / "ignore"))
    assert ignores == ("skip",)
    got = {(r.file, r.text) for r in files.read_tree(spark, str(root), ignores=ignores).collect()}
    assert got == {(n, f"{n}\nx") for n in ("one.md", "two.py", "deep/four.txt")}


def test_query_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"items": [{"id": "q1", "query": "x", "gold": [1]}], "stats": {}}))
    (tmp_path / "b.json").write_text(json.dumps(["u", "v"]))
    assert {tuple(r) for r in files.read_queries(spark, str(tmp_path)).collect()} == {("q1", "x"), ("neg-0", "u"), ("neg-1", "v")}


def test_flat_matrices(spark, tmp_path):
    m = np.arange(12, dtype="<f4").reshape(4, 3)
    (tmp_path / "m.bin").write_bytes(m.tobytes())
    assert [list(r.v) for r in files.read_matrix(spark, str(tmp_path / "m.bin"), 3, 4).orderBy("id").collect()] == m.tolist()
    for dims, expect in ((5, None), (3, 5)):
        with pytest.raises(Exception, match="are not"):
            files.read_matrix(spark, str(tmp_path / "m.bin"), dims, expect).collect()


def test_landing(spark):
    todo, manifest = files.landing(spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "id string"), spark.createDataFrame([("b",), ("z",)], "id string"))
    assert sorted(r.id for r in todo.collect()) == ["a", "c"]
    assert tuple(manifest.first()) == (3, 1, 2)


def test_added_lines_of_diffs(spark):
    diff = ["diff --git a/x b/x", "--- a/x", "+++ b/x", "@@ -1 +3,2 @@ f", "+new", "-old", "+more", "@@ -9 +20 @@", "+last", "--- a/y", "+++ b/y", "@@ -0,0 +1 @@", "+only"]
    rows = spark.createDataFrame([("d", i, v) for i, v in enumerate(diff)], "name string, p int, value string")
    assert sorted(tuple(r) for r in files.added_lines(rows).collect()) == [("x", 3, "new"), ("x", 4, "more"), ("x", 20, "last"), ("y", 1, "only")]


def test_codes_and_rankings_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "id long, v array<double>")
    fitted = quantise.fit(rows)
    coded = rows.crossJoin(fitted).withColumn("c", quantise.codes(F.col("v"), F.col("mu"), F.col("s")))
    assert sinks.write_codes(coded, fitted, str(tmp_path / "q")) == 5
    back = spark.read.parquet(str(tmp_path / "q" / "codes"))
    assert {r.id: list(r.c) for r in back.collect()} == {0: [-127, 0], 1: [-64, 0], 2: [0, 0], 3: [64, 0], 4: [127, 0]}
    sinks.write_ranking(spark.createDataFrame([(1, 2, 1, 0.5)], "item long, id long, rank int, score double"), str(tmp_path / "r"))
    assert json.loads(spark.read.text(str(tmp_path / "r")).first()[0]) == {"item": 1, "id": 2, "rank": 1, "score": 0.5}


def test_packs_are_checked(spark, tmp_path):
    rankings = spark.createDataFrame([("a", 1, 10 + i, i + 1) for i in range(60)] + [("b", 1, 7, 1)], "method string, item long, id long, rank int")
    gold, items = spark.createDataFrame([(1, 12), (1, 99)], "item long, id long"), spark.createDataFrame([(1, "x"), (2, "x")], "item long, grp string")
    packed = evalpack.pack(rankings, gold, items, ("a", "b"), excluded=gold.limit(0))
    evalpack.store(packed, str(tmp_path / "p"))
    held = evalpack.load(spark, str(tmp_path / "p"), ("a", "b"))
    rows = {r.item: r for r in held.collect()}
    assert len(rows[1].a) == 50 and rows[1].b == [7] and rows[2].a == [] and rows[1].gold == [12, 99]
    got = {r.method: tuple(r)[1:] for r in evalpack.metrics(held, ("a", "b")).collect()}
    assert got["a"][:4] == (2, 0.25, 0.5, round((1 / 3) / 2, 9)) and got["b"][:4] == (2, 0.0, 0.0, 0.0)
    assert evalpack.metrics(held, ("a", "b"), group="none").count() == 0
    evalpack.store(packed.unionByName(packed), str(tmp_path / "twice"))
    evalpack.store(packed.withColumn("a", F.array(F.lit(3).cast("long"), F.lit(3).cast("long"))), str(tmp_path / "repeat"))
    for bad in ("twice", "repeat"):
        with pytest.raises(ValueError, match="not a pack"):
            evalpack.load(spark, str(tmp_path / bad), ("a", "b"))


def test_containing(spark):
    docs = spark.createDataFrame([(1, "abc abd"), (2, ""), (3, None), (4, "bcd")], "id long, text string")
    items = spark.createDataFrame([(1, "bc"), (2, "bc"), (3, ""), (4, None), (5, "zz"), (6, "c")], "item long, text string")
    want = {(1, 1), (2, 1), (1, 4), (2, 4), (3, 1), (3, 2), (3, 4), (6, 1), (6, 4)}
    for group in (1, 2, 100):
        got = [tuple(r) for r in ranking.containing(docs, items, group).collect()]
        assert set(got) == want and len(got) == len(want)
    assert ranking.containing(docs, items.limit(0)).count() == 0


def test_ranking_in_blocks_with_exclusions(spark, monkeypatch):
    """Blocks of terms, groups of queries and excluded pairs give what the declarative form gives."""
    import random

    random.seed(8)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    docs = spark.createDataFrame([(i, " ".join(random.choices(words, k=random.randint(0, 12)))) for i in range(120)], "id long, text string").repartition(3)
    asked = spark.createDataFrame([(i, " ".join(random.choices(words, k=2))) for i in range(7)], "item long, text string")
    barred = spark.createDataFrame([(i, j) for i in range(7) for j in range(0, 120, i + 2)], "item long, id long")
    want = [tuple(r) for r in ranking.bm25(index.build(docs), asked, 5, exclude=barred).select("item", "rank", "id", "score").orderBy("item", "rank").collect()]
    monkeypatch.setattr(sparse_blocks, "TERMS", 3)
    monkeypatch.setattr(sparse_blocks, "QUERIES", 2)
    monkeypatch.setattr(sparse_blocks, "SLICE", 200)
    got = [tuple(r) for r in sparse_blocks.rank(docs, asked, 5, exclude=barred).select("item", "rank", "id", "score").orderBy("item", "rank").collect()]
    assert got == want
    assert sparse_blocks.rank(docs, asked.limit(0), 5).count() == 0


def test_validation_gives_an_exit_code(spark):
    tax = spark.createDataFrame([("code", "F01")], "kind string, code string")
    good = json.dumps({"v": "1.2", "ts": "t1", "project": "p", "loop_id": "a", "event": "loop_start", "data": {"goal": "g", "spec_refs": [], "scaffold_version": "1", "agent": "n"}})
    old = good.replace('"1.2"', '"1.1"').replace('"project": "p"', '"project": "a"')
    made = lambda *lines: eventlog.parse(spark.createDataFrame([("a.jsonl", i + 1, t) for i, t in enumerate(lines)], "file string, line long, text string"))
    for lines, code, rules in (((good,), 0, set()), ((old,), 0, {"project_is_loop"}), ((good, "{x"), 1, {"json"})):
        found, said = checks.validation(made(*lines), tax)
        assert said == code and {r.rule for r in found.collect()} == rules


def test_landed_windows_are_closed_ones(spark, tmp_path):
    """Only windows that the watermark has passed are written, once, and a second run goes on where the first ended."""
    import datetime as dt

    def put(name, rows):
        table = pa.table([list(c) for c in zip(*rows, strict=True)], ["event_id", "ts", "user_id", "event_type", "value"])
        pq.write_table(table, tmp_path / name)

    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    put("events1.parquet", [(1, day(1), 1, "a", 1.0), (2, day(1, 5), 1, "a", 2.0), (3, day(5), 1, "a", 4.0)])
    go = lambda: streams.land(streams.windowed(streams.read(spark, str(tmp_path / "events*.parquet"))), str(tmp_path / "out"), str(tmp_path / "check"))
    go()
    assert [(r.start.day, r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 2, 3.0)]
    put("events2.parquet", [(4, day(1, 7), 1, "a", 9.0), (5, day(9), 1, "a", 1.0)])  # the first comes too late
    go()
    assert sorted((r.start.day, r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 2, 3.0), (5, 1, 4.0)]


def test_corrected_records_leave_the_stream(spark, tmp_path):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [("f", 1, at(0), "commit", None), ("f", 2, at(1), "failure", None), ("f", 3, at(2), "correction", 2), ("g", 2, at(1), "failure", None), ("z", 1, dt.datetime(2024, 2, 1), "commit", None), ("z", 2, dt.datetime(2024, 3, 1), "commit", None)]
    pq.write_table(pa.table([list(c) for c in zip(*rows, strict=True)], ["file", "line", "ts", "event", "target"]), tmp_path / "r.parquet")
    out = streams.drain(streams.without_corrected(streams.read(spark, str(tmp_path / "r.parquet"))), "append")
    got = {(r.file, r.line) for r in out.collect()}
    assert {("f", 1), ("g", 2)} <= got and ("f", 2) not in got and ("f", 3) not in got


def test_numbers_as_text(spark):
    row = spark.range(1).select(T.fixed(F.lit(1234.56789)).alias("a"), T.fixed(F.lit(0.5), 2, 8).alias("b"), T.fixed(F.lit(123456.0), 0, 3).alias("c"), T.strip_ansi(F.lit("\x1b[32m20 passed\x1b[0m")).alias("d")).first()
    assert tuple(row) == ("1234.5679", "    0.50", "123456", "20 passed")
