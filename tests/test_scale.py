"""What keeps the work of large tables small: plans and sizes, next to the results."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from pagelens.checks import retrieval as CR
from pagelens.functions import redact as R
from pagelens.functions import text as T
from pagelens.operators import bounds as B
from pagelens.operators import chunks as C
from pagelens.operators import vectors as V
from pagelens.plans import index as I
from pagelens.plans import ingest as IN
from pagelens.plans import search as SE
from pagelens.sources import testdata as TD


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_cut_in_batches_and_blanks_are_those_of_the_pattern(spark):
    rows = [(1, "a b﻿c  d"), (2, "x\x1cy " * 3), (3, " \t "), (4, None), (5, " short \x85"), (6, "é " * 12)]
    df = spark.createDataFrame(rows, "document_id long, text string")
    cut = C.chunk(df, window=5, overlap=2)
    assert "MapInArrow" in plan(cut) and "transform" not in plan(cut)
    got = sorted((r["document_id"], r["ord"], r["text"]) for r in cut.collect())
    long = " ".join(["é"] * 5)
    assert got == [(1, 0, "a b﻿c  d"), (2, 0, "x\x1cy x\x1cy x\x1cy"), (4, 0, None), (5, 0, "short\x85"),
                   (6, 0, long), (6, 1, long), (6, 2, long), (6, 3, " ".join(["é"] * 3))]


def test_an_excerpt_reads_the_beginning_alone(spark):
    texts = ["word " * 2000, " " * 5000 + "late " * 100, "short", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.excerpt(F.col("t")).alias("e"))
    assert "substring(t" in plan(df).replace("#", " ").replace("substring(t ", "substring(t")
    got = [r["e"] for r in df.orderBy("i").collect()]
    assert got == ["word " * 47 + "word…", "late " * 47 + "late…", "short", None]


def test_terms_are_counted_in_place_and_dealt_once(spark):
    chunks = spark.createDataFrame([(1, 10, "ab ab cd x"), (1, 10, "ab"), (2, 20, None)], "document_id long, chunk_id long, text string")
    counted = I.text_postings(chunks)
    assert plan(counted).count("Exchange") == 1 and "Generate" not in plan(counted)
    got = sorted((r["chunk_id"], r["term"], r["tf"]) for r in counted.collect())
    assert got == [(10, "", 4), (10, "ab", 3), (10, "cd", 1), (20, "", 0)]


def test_secrets_are_first_looked_for_by_what_every_match_holds(spark):
    df = spark.createDataFrame([(0, "no secret at all"), (1, "BEARER abcdefghij.klmnopqrst"), (2, "4111 1111-1111 1111"), (3, "4111 1111 1111 1112")], "i int, t string")
    out = df.select("i", R.redact(F.col("t")).alias("r"), F.array_join(R.pii_types(F.col("t")), ",").alias("k"))
    assert "(?:[ \\t-]*+[0-9]){12}" in plan(out)
    got = [(r["r"], r["k"]) for r in out.orderBy("i").collect()]
    assert got == [("no secret at all", ""), ("[REDACTED]", "bearer"), ("[REDACTED]", "credit_card"), ("4111 1111 1111 1112", "")]


def test_nearest_vectors_come_from_tiles_and_bad_components_hide_none(spark, monkeypatch):
    monkeypatch.setattr(V, "TILE", 3)
    rng = np.random.default_rng(5)
    given = np.round(rng.normal(size=(40, 3)))
    units = V.unit_rows(given.tolist())
    units[4, 1] = np.nan
    places, cosine = V._best(units[:7], units, 5)
    scores = np.round(units[:7] @ units.T, 10)
    for q in range(7):
        want = [] if q == 4 else sorted((i for i in range(40) if np.isfinite(scores[q, i])), key=lambda i: (-scores[q, i], i))[:5]
        assert [p for p in places[q] if p >= 0] == want
        assert np.allclose([c for c in cosine[q] if np.isfinite(c)], scores[q, want])


def test_texts_without_a_vector_are_not_shuffled_to_meet_one(spark, tmp_path, monkeypatch):
    long = " ".join(["word"] * 500)
    texts = [(1, long), (2, "b " * 30), (2, "again " * 20), (None, "c " * 30), (4, None), (5, long)]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(1, [1.0]), (2, [2.0]), (2, [3.0]), (None, [4.0]), (9, [5.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = []
    for limit in (TD.VECTOR_IDS, 0):
        monkeypatch.setattr(TD, "VECTOR_IDS", limit)
        df = TD.chunks(spark, str(tmp_path))
        assert ("LeftAnti" in plan(df)) == (limit > 0)
        key = F.coalesce("document_id", F.lit(0))
        got.append([(r["document_id"], r["ord"], r["text"], r["embedding"], r["embed_state"]) for r in df.orderBy(key, "ord", "text", "embedding").collect()])
    assert got[0] == got[1]
    assert [(d, o, e, s) for d, o, _, e, s in got[0]] == [
        (None, 0, None, "pending"), (1, 0, [1.0], "embedded"), (1, 1, None, "pending"), (2, 0, [2.0], "embedded"), (2, 0, [3.0], "embedded"),
        (2, 0, [2.0], "embedded"), (2, 0, [3.0], "embedded"), (4, 0, None, "pending"), (5, 0, None, "pending"), (5, 1, None, "pending")]


def test_a_segment_has_a_row_for_each_chunk_and_moves_no_terms(spark):
    rows = [("u", 1, "old words"), ("u", 2, "ab ab " + "cd " * 420), ("v", 1, None), (None, 1, "ef")]
    pages = spark.createDataFrame(rows, "url string, seq long, text string")
    segment = IN.page_postings(pages)
    # One exchange at most, for the last page of each address; none behind the counting.
    assert plan(segment).split("MapInArrow")[0].count("Exchange") == 0
    got = {(r["url"], r["ord"]): dict(zip(r["terms"], r["tfs"], strict=True)) for r in segment.collect()}
    assert got == {("u", 0): {"ab": 2, "cd": 418, "": 420}, ("u", 1): {"cd": 77, "": 77}, ("v", 0): {"": 0}, (None, 0): {"ef": 1, "": 1}}


def test_pairs_of_queries_and_chunks_are_added_up_where_the_chunks_lie(spark):
    found = spark.createDataFrame([(1, 10, "ab", 2), (1, 10, "cd", 1), (2, 20, "ab", 5), (2, 20, "zz", 1)], "document_id long, chunk_id long, key string, tf long")
    terms = spark.createDataFrame([(7, "ab"), (7, "cd"), (8, "ab")], "query_id long, key string")
    counted = CR.pair_counts(found.repartition("document_id", "chunk_id"), terms)
    assert plan(counted).count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, counted.collect())) == [(7, 10, 2, 3), (7, 20, 1, 5), (8, 10, 1, 2), (8, 20, 1, 5)]


def test_all_pairs_are_scored_in_matrices_when_none_is_cut(monkeypatch):
    def never(*_):
        raise AssertionError("pairs scored one at a time")

    monkeypatch.setattr(B.Entries, "add", never)
    weights = np.array([5.0, 0.1, 3.0])
    none = B.Entries(*[np.array([], t) for t in (int, int, float, float)])
    asked = B.Asked(
        np.array([7, 8]), 2, np.array([True, True]), 4.0, np.zeros(2), np.array([-1, -1]), [], [None, None],
        B.Entries(np.array([0, 0, 1]), np.array([0, 1, 0]), weights, 2.4 * weights), none, none, np.zeros(2), np.array([12.0, 7.0]))
    rows = [(1, 10, 4, [0, 1], [1, 2]), (2, 20, 4, [1], [1]), (3, 30, 4, [], [])]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    bare = [pa.array([0.5] * 3), pa.array([0.5] * 3), pa.array([False] * 3), pa.array([[]] * 3, pa.list_(pa.int32()))]
    batch = pa.RecordBatch.from_arrays([*columns, *bare], ["document_id", "chunk_id", "dl", "keys", "times", "recency", "engagement", "on_profile", "nodes"])
    got = {(r["query_id"], r["chunk_id"]): r["bm25"] for out in B.contenders(asked, 3)(iter([batch])) for r in out.to_pylist()}
    once, twice = 2.35 / 2.35, 2 * 2.35 / 3.35
    assert got.keys() == {(7, 10), (7, 20), (8, 10)}
    assert np.allclose([got[7, 10], got[7, 20], got[8, 10]], [5 * once + 0.1 * twice, 0.1 * once, 3 * once])


def test_large_batches_are_worked_on_in_parts(monkeypatch):
    monkeypatch.setattr(SE, "TEXT_ROWS", 3)
    monkeypatch.setattr(SE, "VECTOR_ROWS", 2)
    batch = pa.RecordBatch.from_arrays([pa.array(range(7))], ["i"])
    assert [p.column(0).to_pylist() for p in SE.pieces(iter([batch]))] == [[0, 1, 2], [3, 4, 5], [6]]
    rows = pd.DataFrame([(2, 21), (1, 11), (2, 20)], columns=["document_id", "chunk_id"])
    assert [p.values.tolist() for p in SE.sorted_parts(iter([rows, rows[:0]]))] == [[[1, 11], [2, 20]], [[2, 21]]]
    assert all(list(p.index) == list(range(len(p))) for p in SE.sorted_parts(iter([rows])))
