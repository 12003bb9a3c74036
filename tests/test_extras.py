"""Codecs, sinks, search stages, encoders, streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkshelf.operators import codec, search, sinks
from sparkshelf.sources import statutes
from sparkshelf.streaming import events


@pytest.mark.parametrize("n", [0, 1, 127, 128, 16383, 16384, 2**31 - 1])
def test_varint(n):
    assert codec.decode(codec.encode([n, 5, n])) == [n, 5, n]


def test_csv_has_all_columns_in_order_of_appearance_and_a_mark(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "k int, p string"), spark.createDataFrame([(2, True)], "k int, q boolean")
    sinks.write_csv([a, b], str(tmp_path / "c"))
    lines = [x for f in (tmp_path / "c").glob("part-*") for x in f.read_text(encoding="utf-8").splitlines()]
    assert set(lines) == {"﻿k,p,q", "1,x,", "2,,true"}


def test_empty_tables_and_wrong_vectors_are_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.write_table(spark.range(0), str(tmp_path / "t"))
    rows = spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<float>")
    assert sinks.write_vectors(rows, str(tmp_path / "v"), 2) == 1
    with pytest.raises(Exception, match="3 dimensions"):
        sinks.write_vectors(rows, str(tmp_path / "w"), 3)


def test_sizes_and_reports(spark, tmp_path):
    sinks.write_report(spark.createDataFrame([("a", 1.0)], "metric string, value double"), str(tmp_path / "r"))
    assert [json.loads(x) for f in (tmp_path / "r").glob("part-*") for x in f.read_text().splitlines()] == [{"metric": "a", "value": 1.0}]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/text.bin").write_bytes(b"123")
    (tmp_path / "d/index.bin").write_bytes(b"12345")
    got = {r.stage: (r.bytes, r.files) for r in sinks.sizes(spark, str(tmp_path / "d"), {"first": "text"}).collect()}
    assert got == {"first": (3, 1), "other": (5, 1)}


def test_search_stages(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, "delta")], "id long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "id long, v array<float>")
    got = search.search(docs, "gamma", vectors, [0.0, 1.0], k=2)
    shown = got["shown"].collect()
    assert [r.id for r in shown] == [2, 3] and shown[0].sparse_rank == 1 and shown[0].dense_rank == 1 and shown[1].sparse_rank is None
    assert set(search.search(docs, "gamma", method="sparse")) == {"sparse", "fused", "shown"}
    with pytest.raises(ValueError):
        search.search(docs, "gamma", method="dense")


def test_encoder_hook(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "id long, text string")
    got = {r.id: r.v for r in search.encode(docs, lambda texts: np.array([[len(t), 1.0] for t in texts]), "q: ").collect()}
    assert abs(np.linalg.norm(got[1]) - 1) < 1e-6 and got[1][0] > got[2][0]


def test_differences(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (4, None)], "k int, v string")
    assert {(r.k, r.side) for r in search.differences(a, b, "k").collect()} == {(2, "both"), (3, "first"), (4, "second")}


def test_latest_of_equal_titles(spark):
    known = spark.createDataFrame([("t", "a", "2001-01-01"), ("t", "b", "2002-01-01"), ("u", "c", "2000-01-01")], "title string, law_id string, promulgated string")
    got = {r.title: (r.law_id, r.ambiguous) for r in statutes.latest_by_title(known, spark.createDataFrame([("t",), ("u",), ("x",)], "title string")).collect()}
    assert got == {"t": ("b", True), "u": ("c", False), "x": (None, False)}


def test_stream_windows_equal_a_batch(spark, tmp_path):
    rows = [(i, f"2026-01-0{1 + i % 3} 0{i % 9}:00:00", i % 4, "a" if i % 2 else "b", float(i)) for i in range(40)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "e" / "events.parquet"))
    path = str(tmp_path / "e" / "events.parquet")
    got = events.drain(events.windowed(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)))
    batch = spark.read.parquet(path).groupBy(F.date_trunc("day", "ts").alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


@pytest.mark.parametrize("turned", [False, True])
def test_late_rows_with_equal_ids_and_without_times(spark, tmp_path, turned):
    """Equal ids of a user go by time, in whatever order they stand in the file; a row without a time hides no late row."""
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [(5, at(1), 7), (5, at(9), 7), (5, at(4), 7), (6, None, 7), (8, at(3), 7), (1, None, 8), (2, at(2), 8)]
    schema = "event_id long, ts timestamp, user_id long"
    spark.createDataFrame(rows[::-1] if turned else rows, schema).coalesce(1).write.parquet(str(tmp_path / "e.parquet"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "e.parquet"))
    got = events.drain(events.late_rows(stream), "append").select("event_id", "user_id", "behind").collect()
    assert [tuple(r) for r in got] == [(8, 7, 6 * 60 * 1_000_000)]


def test_places_and_quantiles_over_ranges(spark):
    import random

    from sparkshelf.operators.numbering import numbered, quantiles

    random.seed(7)
    values = [random.randint(0, 60) for _ in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v long").repartition(4)
    got = sorted((r.place, r.v, r.i) for r in numbered(df, "v", "i").collect())
    assert got == [(k, v, i) for k, (v, i) in enumerate(sorted((v, i) for i, v in enumerate(values)))]
    shares = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    want = {n: sorted(values)[min(int(500 * s), 499)] for n, s in shares.items()}
    assert quantiles(df, "v", shares).first().asDict() == want
    assert tuple(quantiles(df.where("v < 0"), "v", shares).first()) == (None,) * 5
    assert numbered(df.where("v < 0"), "v").count() == 0
