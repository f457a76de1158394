import random
from datetime import timedelta

import numpy as np
import pytest
from helpers import NOW, as_of
from pyspark.sql import functions as F

from pagelens.model import TABLES, Policy
from pagelens.operators import activity as A
from pagelens.operators import vectors as V
from pagelens.plans import index as I
from pagelens.plans import search as SE
from pagelens.streaming import events as EV
from pagelens.streaming import ingest as SI
from pagelens.streaming import limits as LI
from pagelens.streaming import store as ST

CALL = "key string, ts timestamp, call_id long"
PAGE = "tenant_id long, url string, title string, text string, visited_at timestamp, seq long"


def drain(df, tmp_path, name, mode="append"):
    query = (df.writeStream.format("parquet" if mode == "append" else "memory").option("checkpointLocation", str(tmp_path / f"{name}-c"))
             .option("path", str(tmp_path / name)).outputMode(mode).trigger(availableNow=True).start())
    query.awaitTermination()
    return df.sparkSession.read.parquet(str(tmp_path / name))


def files(spark, rows, schema, directory, parts):
    """Rows in several files that a stream reads one after the other."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.mode("append").parquet(directory)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(directory)


def test_limits_on_a_stream_equal_the_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = sorted((rng.choice("ab"), NOW + timedelta(seconds=rng.randint(0, 600))) for _ in range(300))
    rows = [(k, t, i) for i, (k, t) in enumerate(sorted(rows, key=lambda r: r[1]))]
    stream = files(spark, rows, CALL, str(tmp_path / "in"), 3)
    got = drain(LI.rate_limit_stream(stream, "key", 4), tmp_path, "out").collect()
    want = A.rate_limit(spark.createDataFrame(rows, CALL), "key", 4).collect()
    assert {r["call_id"]: r["allowed"] for r in got} == {r["call_id"]: r["allowed"] for r in want}


def test_keys_are_forgotten_after_a_window(spark, tmp_path):
    first = [(f"k{i}", NOW + timedelta(seconds=i % 50), i) for i in range(40)] + [("k0", NOW + timedelta(seconds=55), 40)]
    rows = [*first, ("z", NOW + timedelta(hours=1), 90), ("k1", NOW + timedelta(hours=1, seconds=1), 91), ("z", NOW + timedelta(hours=3), 92)]
    stream = files(spark, rows[:41], CALL, str(tmp_path / "in"), 1)
    for row in rows[41:]:
        spark.createDataFrame([row], CALL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = drain(LI.rate_limit_stream(stream, "key", 1, lateness="1 minute"), tmp_path, "out").collect()
    want = A.rate_limit(spark.createDataFrame(rows, CALL), "key", 1).collect()
    assert {r["call_id"]: r["allowed"] for r in got} == {r["call_id"]: r["allowed"] for r in want}
    state = spark.read.format("statestore").option("path", str(tmp_path / "out-c")).option("stateVarName", "recent").load()
    assert {r["key"][0] for r in state.select("key").collect()} <= {"z", "k1"}


def test_idle_capture_on_a_stream_equals_the_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = sorted((rng.choice("ab"), NOW + timedelta(seconds=rng.randint(0, 4_000))) for _ in range(200))
    rows = [(k, t, i) for i, (k, t) in enumerate(sorted(rows, key=lambda r: r[1]))]
    late = [("z", NOW + timedelta(days=9), 999)]
    stream = files(spark, rows + late, CALL, str(tmp_path / "in"), 1)
    got = drain(EV.idle_capture_stream(stream, "key", "60 seconds", order="call_id"), tmp_path, "out")
    want = A.idle_capture(spark.createDataFrame(rows, CALL), "key", 60, "call_id")
    assert {r["call_id"] for r in got.collect()} - {999} == {r["call_id"] for r in want.collect()}


def test_repeats_are_dropped(spark, tmp_path):
    rows = [(0, "u", "t", "same", NOW, 1), (0, "u", "t", "same", NOW + timedelta(minutes=1), 2), (0, "u", "t", "other", NOW, 3), (0, "v", "t", "same", NOW, 4)]
    got = drain(EV.drop_repeats(files(spark, rows, PAGE, str(tmp_path / "in"), 1)), tmp_path, "out")
    assert got.count() == 3


def test_activity_per_day(spark, tmp_path):
    rows = [("u", NOW), ("v", NOW), ("u", NOW + timedelta(days=1)), ("w", NOW + timedelta(days=30))]
    stream = files(spark, rows, "url string, visited_at timestamp", str(tmp_path / "in"), 1)
    got = drain(EV.visit_activity_stream(stream), tmp_path, "out").orderBy("start").collect()
    assert [(r["visits"], r["pages"]) for r in got] == [(2, 2), (1, 1)]


def test_pages_flow_into_the_library(spark, tmp_path):
    text = "some words to read about things " * 10
    rows = [(0, f"https://a.test/{i % 3}", "T", text + str(i), NOW + timedelta(minutes=i), i) for i in range(6)]
    rows += [(0, "https://a.test/login", "T", text, NOW, 6), (0, "https://b.test/", "T", "short", NOW, 7)]
    stream = files(spark, rows, PAGE, str(tmp_path / "in"), 2)
    home = str(tmp_path / "library")
    SI.stream_ingest(stream, home, str(tmp_path / "c"), Policy()).awaitTermination()
    opened = ST.open_library(spark, home, as_of())
    assert {r["url"]: r["visit_count"] for r in opened.documents.collect()} == {f"https://a.test/{i}": 2 for i in range(3)}
    assert sorted(r["text"][-1] for r in opened.chunks.collect()) == ["3", "4", "5"]
    assert ST.compact(spark, home, as_of(), lambda: V.hashing_embedder, limits={"max_documents": 2}) == 1
    assert ST.compact(spark, home, as_of()) == 1
    base = ST.open_library(spark, home, as_of())
    assert base.documents.count() == 2 and {r["embed_state"] for r in base.chunks.collect()} == {"embedded"}
    # A replayed batch replaces its own files.
    again = spark.createDataFrame([(0, "https://c.test/", "d", "T", text, "s", NOW, 9)], ST.DELTA)
    for _ in range(2):
        ST.append_batch(again, home, 7)
    assert ST.open_library(spark, home, as_of()).documents.filter("url = 'https://c.test/'").first()["visit_count"] == 1


def test_two_streams_share_a_library_and_ids_stay(spark, tmp_path):
    text = "some words to read about things " * 10
    home = str(tmp_path / "library")

    def run(name, rows, parts=1):
        stream = files(spark, rows, PAGE, str(tmp_path / name), parts)
        SI.stream_ingest(stream, home, str(tmp_path / f"c-{name}"), Policy()).awaitTermination()
        return {r["url"]: r["document_id"] for r in ST.open_library(spark, home, as_of()).documents.collect()}

    def page(i, extra=""):
        return (0, f"https://a.test/{i}", "T", text + extra, NOW + timedelta(minutes=i), i)

    # Both count their batches from 0; so does a fresh checkpoint of the first.
    first = run("a", [page(i) for i in range(5, 15)], 2)
    second = run("b", [page(i, "again") for i in range(10)])
    assert len(second) == 15 and first.items() <= second.items() and sorted(second.values()) == list(range(15))
    assert ST.compact(spark, home, as_of(), limits={"max_documents": 4}) == 1
    kept = {r["url"]: r["document_id"] for r in ST.open_library(spark, home, as_of()).documents.collect()}
    assert len(kept) == 4 and kept.items() <= second.items()
    third = run("fresh", [page(i) for i in range(20, 23)])
    # Numbers of evicted documents aren't given again.
    assert kept.items() <= third.items() and sorted(set(third.values()) - set(kept.values())) == [15, 16, 17]
    assert ST.compact(spark, home, as_of()) == 2 and ST.current_base(spark, home)[2] == 18


def test_search_over_segments_equals_search_after_a_rebuild(spark, tmp_path):
    rng = random.Random(6)
    home, words = str(tmp_path / "library"), "alpha beta gamma delta epsilon zeta eta theta".split()

    def pages(numbers, seq):
        rows = [(0, f"https://a.test/{i}", "a.test", rng.choice(words).title(), " ".join(rng.choices(words, k=rng.choice([5, 60, 900]))), "sum", NOW - timedelta(hours=i), seq + i)
                for i in numbers]
        return spark.createDataFrame(rows, ST.DELTA)

    asked = spark.createDataFrame([(0, "alpha zeta"), (1, "theta"), (2, "unknown beta")], "query_id long, text string")

    def hits(lib):
        return [(r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in SE.hybrid_search(asked, lib, as_of(), k=6).orderBy("query_id", "rank").collect()]

    for batch, (numbers, fold) in enumerate([(range(12), True), (range(6, 18), False), ([1, 7, 17], False)]):
        ST.append_batch(pages(numbers, batch * 100), home, batch)
        if fold:
            ST.compact(spark, home, as_of())
    lib = ST.open_library(spark, home, as_of())
    rebuilt = lib.with_tables(postings=None)
    assert hits(lib) == hits(rebuilt) and len(hits(lib)) == 18

    def table(df):
        return sorted(map(tuple, df.select("document_id", "chunk_id", "term", "tf").collect()))

    assert table(lib.postings) == table(I.build_index(rebuilt).postings)
    ST.compact(spark, home, as_of(), limits={"max_documents": 5})
    small = ST.open_library(spark, home, as_of())
    assert small.documents.count() == 5 and table(small.postings) == table(I.build_index(small).postings)


def test_calls_over_the_limit_are_not_indexed(spark, tmp_path):
    text = "some words to read about things " * 10
    rows = [(0, f"https://a.test/{i}", "T", text, NOW + timedelta(seconds=i), i) for i in range(5)]
    stream = files(spark, rows, PAGE, str(tmp_path / "in"), 1)
    SI.stream_ingest(stream, str(tmp_path / "l"), str(tmp_path / "c"), Policy(), per_minute=2).awaitTermination()
    assert ST.open_library(spark, str(tmp_path / "l"), as_of()).documents.count() == 2
    told = spark.read.parquet(str(tmp_path / "l" / "outcomes")).collect()
    assert sorted((r["seq"], r["outcome"], r["reason"]) for r in told) == [(i, *(("indexed", None) if i < 2 else ("skipped", "rate_limited"))) for i in range(5)]


def test_tenants_have_limits_of_their_own(spark, tmp_path):
    text = "some words to read about things " * 10
    rows = [(i % 3, f"https://a.test/{i}", "T", text, NOW + timedelta(seconds=i), i) for i in range(9)]
    for name, limit, kept in (("each", 2, 6), ("none", None, 9)):
        stream = files(spark, rows, PAGE, str(tmp_path / f"in-{name}"), 1)
        SI.stream_ingest(stream, str(tmp_path / name), str(tmp_path / f"c-{name}"), Policy(), per_minute=limit).awaitTermination()
        assert ST.open_library(spark, str(tmp_path / name), as_of()).documents.count() == kept


def test_vectors_on_a_stream_and_failures(spark, tmp_path):
    def bad_embedder():
        def embed(texts):
            if any("bad" in t for t in texts):
                raise ValueError("bad text")
            return [np.ones(2) for _ in texts]
        return embed

    rows = [(1, i, 0, t, None, s, None, None) for i, (t, s) in enumerate(
        [("fine", "pending"), ("bad", "pending"), (" ", "pending"), ("done", "failed")])]
    stream = files(spark, rows, TABLES["chunks"], str(tmp_path / "in"), 1)
    SI.stream_embed(stream, str(tmp_path / "out"), str(tmp_path / "c"), as_of(), bad_embedder).awaitTermination()
    got = {r["chunk_id"]: r["embed_state"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: "embedded", 1: "failed", 2: "skipped", 3: "failed"}
    assert V.embed_coverage(spark.read.parquet(str(tmp_path / "out"))).count() == 3


def test_nearest_vectors(spark):
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(50)] + [(50, None), (51, [0.0] * 4), (52, [1.0])]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)
    asked = spark.createDataFrame(data[:5], "query_id long, vector array<float>")
    got = V.semantic_top_k(vectors, asked, 3).collect()
    for q in range(5):
        sims = sorted(((-np.float32(v) @ np.float32(data[q][1]) / np.linalg.norm(np.float32(v)) / np.linalg.norm(np.float32(data[q][1])), i) for i, v in data[:50]))
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [i for _, i in sims[:3]]
    cells = V.semantic_top_k(vectors, asked, 3, rows=2)
    assert sorted(cells.collect()) == sorted(got) and "Broadcast" not in cells._jdf.queryExecution().toString()
    named = V.semantic_top_k(vectors.withColumn("vec_id", F.format_string("%03d", "vec_id")), asked.withColumn("query_id", F.col("query_id").cast("string")), 3, rows=7)
    assert {(int(r["query_id"]), int(r["vec_id"]), r["rank"]) for r in named.collect()} == {(r["query_id"], r["vec_id"], r["rank"]) for r in got}
    assert V.semantic_top_k(vectors.limit(0), asked, 3).count() == V.semantic_top_k(vectors, asked.limit(0), 3).count() == 0
    assert pytest and F
