"""Segments and bases of a growing library: what is shuffled, and that nothing is lost by it."""

from __future__ import annotations

import pytest
from helpers import as_of
from pyspark.sql import functions as F

from pagelens.plans import index as I
from pagelens.plans import ingest as IN
from pagelens.streaming import store as ST

PAGES = [("u", 1, "old"), ("u", 2, "new"), ("v", 1, None), (None, 1, "ef"), (None, 3, "gh"), ("w", None, "lost"), ("x", 5, "alone"), ("y", 2, None), ("y", 1, "kept out")]


@pytest.mark.parametrize("limit", [100_000, 1])
def test_the_last_page_of_each_address(spark, monkeypatch, limit):
    monkeypatch.setattr(IN, "REPEATED", limit)
    pages = spark.createDataFrame(PAGES, "url string, seq long, text string")
    want = pages.groupBy("url").agg(F.max("seq").alias("seq"), F.max_by("text", "seq").alias("text"))
    assert sorted(IN.last_pages(pages).collect(), key=repr) == sorted(want.collect(), key=repr)


def test_texts_of_addresses_that_come_once_are_not_shuffled(spark):
    pages = spark.createDataFrame([(str(i), i, "some text") for i in range(20)], "url string, seq long, text string").repartition(4).checkpoint()
    first = IN.last_pages(pages).select("url", F.spark_partition_id().alias("p")).collect()
    there = {r["url"]: r["p"] for r in pages.select("url", F.spark_partition_id().alias("p")).collect()}
    assert {r["url"]: r["p"] for r in first} == there  # each row is where it was


@pytest.mark.parametrize("limit", [2_000_000, 1])
def test_postings_stay_where_they_are_when_some_are_replaced(spark, monkeypatch, limit):
    monkeypatch.setattr(I, "REPLACED", limit)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        schema = "document_id long, chunk_id long, term string, tf long"
        postings = spark.createDataFrame([(d, d * 10, t, 1) for d in range(6) for t in "ab"], schema)
        fresh = spark.createDataFrame([(1, 10, "c", 4)], schema)
        gone = spark.createDataFrame([(1,), (3,), (1,), (None,)], "document_id long")
        got = I.replace_postings(postings, fresh, gone)
        rows = sorted(map(tuple, got.collect()))
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == sorted([(d, d * 10, t, 1) for d in (0, 2, 4, 5) for t in "ab"] + [(1, 10, "c", 4)])
    assert ("BroadcastHashJoin" in plan) == (limit > 1)


def test_compacting_lets_shuffles_go(spark, tmp_path, monkeypatch):
    called = []
    monkeypatch.setattr(ST, "release", lambda s: called.append(s))
    pages = spark.createDataFrame([(0, f"https://a.test/{i}", "a.test", "T", "some words " * 9, "s", None, i) for i in range(3)], ST.DELTA)
    ST.append_batch(pages, str(tmp_path), 0)
    assert ST.compact(spark, str(tmp_path), as_of()) == 1
    assert called == [spark] * len(ST.BASE_TABLES)
