import random
from datetime import timedelta

import pytest
from helpers import NOW, ago, as_of, library
from pyspark.sql import functions as F

from pagelens.functions.questions import DAY_MS  # noqa: F401
from pagelens.model import TABLES, Library
from pagelens.operators import history as H
from pagelens.operators import library as L
from pagelens.operators import spread as SP
from pagelens.sources import tables as ST

VISIT = "url string, domain string, title string, summary string, visited_at timestamp, seq long"


def documents(spark, rows):
    return spark.createDataFrame(rows, TABLES["documents"])


def fold(rows, known):
    """One visit at a time."""
    out = dict(known)
    for url, domain, title, summary, at, _ in sorted(rows, key=lambda r: r[5]):
        if url in out:
            o = out[url]
            gain = 0.07 + min(0.15, len(summary) / 25_000)
            out[url] = (domain or o[0], title or o[1], summary, at, o[4] + 1, min(1, o[5] + gain))
        else:
            out[url] = (domain, title or "Untitled", summary, at, 1, 0.12)
    return out


def test_tables_in_buckets_are_joined_where_they_lie(spark, tmp_path):
    lib = library(spark, [(i, f"u{i}", f"t{i}", ago(days=i), 0.5) for i in range(40)], [(i, o, f"text {o}", None) for i in range(40) for o in range(3)])
    asked = spark.createDataFrame([(i, ago(days=1), ago(hours=1), f"c{i}") for i in range(9)], TABLES["conversations"])
    turns = spark.createDataFrame([(i % 9, i, "user", f"m{i}", ago(minutes=i), None, None) for i in range(30)], TABLES["messages"])
    lib = lib.with_tables(conversations=asked, messages=turns)
    ST.write_buckets(lib, str(tmp_path), "shelf", 4)
    held = ST.read_buckets(spark, "shelf", lib)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for joined, rows in ((held.chunks.join(held.documents, "document_id"), 120), (held.messages.join(held.conversations, "conversation_id"), 30)):
            assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == rows
        one = held.documents.filter("document_id = 7")
        assert one.count() == 1 and one.rdd.getNumPartitions() == 1 < held.documents.rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_upsert_equals_one_visit_at_a_time(spark):
    rng = random.Random(3)
    rows = [(f"u{rng.randint(0, 8)}", rng.choice(["", "d"]), rng.choice(["", f"t{i}"]), "s" * rng.choice([0, 100, 3_750, 9_000]),
             ago(minutes=rng.randint(0, 99)), i) for i in range(120)]
    known = {f"u{i}": ("k", "Known", "old", ago(days=9), 2, 0.4) for i in (0, 1, 20)}
    old = documents(spark, [(i, u, k[0], k[1], k[2], k[3], k[4], k[5]) for i, (u, k) in enumerate(known.items())])
    merged = L.number_new_documents(L.upsert_documents(old, spark.createDataFrame(rows, VISIT).repartition(3)), old)
    got = merged.collect()
    assert {r["url"]: (r["domain"], r["title"], r["summary"], r["last_visited_at"], r["visit_count"], pytest.approx(r["importance"])) for r in got} == fold(rows, known)
    ids = sorted(r["document_id"] for r in got)
    assert ids == list(range(len(got)))


def test_history_equals_one_row_at_a_time(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["https://a.b/x", "https://a.b/x#f", "https://c.d", "ftp://e.f", None, "HTTPS://A.B/x"]),
             rng.choice(["", " ", f"t{i}"]), ago(minutes=rng.randint(0, 6)), i) for i in range(200)]
    want = {}
    for url, title, at, _ in rows:
        if not url or url.startswith("ftp"):
            continue
        key = "https://c.d/" if "c.d" in url else "https://a.b/x"
        if key not in want or at >= want[key][1]:
            want[key] = (title.strip() or (want[key][0] if key in want else key.split("/")[2]), at)
    df = spark.createDataFrame(rows, "url string, title string, visited_at timestamp, seq long")
    for block in (7, 1000):
        got = H.dedupe_history(df, as_of(), block).collect()
        assert {r["url"]: (r["title"], r["visited_at"]) for r in got} == want


def evict(docs, max_documents, max_chunks):
    left = sorted(docs, key=lambda d: (d[1], d[0]))
    while left and (len(left) > max_documents or sum(d[2] for d in left) > max_chunks):
        left.pop(0)
    return {d[0] for d in left}


@pytest.mark.parametrize("max_documents, max_chunks", [(5, 100), (50, 30), (60, 1000), (1, 1), (30, 0)])
def test_retention_equals_evicting_the_oldest(spark, max_documents, max_chunks):
    rng = random.Random(max_documents)
    docs = [(i, ago(hours=rng.randint(0, 5)), rng.choice([0, 1, 1, 3])) for i in range(60)]
    df = documents(spark, [(i, f"u{i}", f"d{i % 2}", "", "", at, 1, 0.1) for i, at, _ in docs])
    counts = spark.createDataFrame([(i, n) for i, _, n in docs if n], "document_id long, n_chunks long")
    got = L.retain(df, counts, (), max_documents, max_chunks)
    assert {r["document_id"] for r in got.collect()} == evict(docs, max_documents, max_chunks)
    by_domain = L.retain(df, counts, ("domain",), max_documents, max_chunks)
    want = evict([d for d in docs if d[0] % 2 == 0], max_documents, max_chunks) | evict(
        [d for d in docs if d[0] % 2], max_documents, max_chunks)
    assert {r["document_id"] for r in by_domain.collect()} == want


def test_migration_keeps_the_later_of_equals(spark):
    rows = [(1, "https://a.b/", "old", ago(days=1), "x", "s", None), (2, "https://a.b/", "new", ago(days=1), "y", "s", None),
            (3, "https://a.b/", "older", ago(days=2), "z", "s", None)]
    pages = spark.createDataFrame(rows, "id long, url string, title string, visited_at timestamp, text string, summary string, embedding array<float>")
    docs, chunks = L.migrate_pages(pages)
    assert [(r["document_id"], r["title"], r["domain"], r["importance"]) for r in docs.collect()] == [(2, "new", "a.b", 0.15)]
    assert [(r["document_id"], r["ord"], r["text"]) for r in chunks.collect()] == [(2, 0, "y")]


def test_top_n_and_running_match_plain_windows(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), rng.randint(0, 30), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t int, i long").withColumn("b", F.floor(F.col("t") / 7))
    top = SP.top_n(df, ["k"], [F.col("t").desc(), F.col("i")], 9, "i").collect()
    numbered = SP.number_rows(df, ["k"], "b", [F.col("t"), F.col("i")], "n").collect()
    following = SP.next_value(df, ["k"], "b", [F.col("t"), F.col("i")], "t", "f").collect()
    for key in "ab":
        mine = sorted([(t, i) for k, t, i in rows if k == key])
        newest = sorted(mine, key=lambda x: (-x[0], x[1]))[:9]
        assert [(r["t"], r["i"]) for r in sorted(top, key=lambda r: r["rank"]) if r["k"] == key] == newest
        assert {r["i"]: r["n"] for r in numbered if r["k"] == key} == {i: n + 1 for n, (_, i) in enumerate(mine)}
        assert {r["i"]: r["f"] for r in following if r["k"] == key} == {
            i: mine[n + 1][0] if n + 1 < len(mine) else None for n, (_, i) in enumerate(mine)}


def test_library_survives_a_round_trip(spark, tmp_path):
    docs = documents(spark, [(1, "u", "d", "t", "s", NOW, 1, 0.5)])
    visits = spark.createDataFrame([(0, "u", "t", "d", NOW - timedelta(days=i), 5) for i in range(4)], TABLES["visits"])
    empty = {n: spark.createDataFrame([], TABLES[n]) for n in ("chunks", "conversations", "messages", "digests")}
    ST.write_library(Library(docs, empty["chunks"], visits, empty["conversations"], empty["messages"], empty["digests"]), str(tmp_path / "lib"))
    back = ST.read_library(spark, str(tmp_path / "lib"))
    assert back.documents.collect() == docs.collect() and back.visits.count() == 4
    day = F.lit(NOW - timedelta(days=2)), F.lit(NOW - timedelta(days=1))
    found = ST.read_visits(spark, str(tmp_path / "lib"), *day)
    assert found.count() == 2 and "PartitionFilters: [isnotnull(visit_date" in found._jdf.queryExecution().toString()
    L.clear_library(spark, str(tmp_path / "lib"))
    assert [r["rows"] for r in L.library_counts(ST.read_library(spark, str(tmp_path / "lib"))).collect()] == [0, 0, 0]


def test_digests_are_replaced_by_range(spark, tmp_path):
    def digest(name, pages):
        return spark.createDataFrame([(name, NOW, pages, 1, "n", [], [], [])], TABLES["digests"])
    ST.save_digests(digest("today", 1).unionByName(digest("yesterday", 2)), str(tmp_path))
    ST.save_digests(digest("today", 7), str(tmp_path))
    got = ST.read_table(spark, str(tmp_path), "digests").collect()
    assert {r["range"]: r["page_count"] for r in got} == {"today": 7, "yesterday": 2}


def test_only_html_pages_are_read(spark, tmp_path):
    rows = [("a", "text/html; charset=utf-8"), ("b", "application/pdf"), ("c", "application/xhtml+xml")]
    spark.createDataFrame(rows, "url string, content_type string").write.parquet(str(tmp_path / "p"))
    assert sorted(r["url"] for r in ST.read_pages(spark, str(tmp_path / "p")).collect()) == ["a", "c"]


def test_a_document_stays_while_one_tenant_has_room(spark):
    lib = library(spark, [(i, f"u{i}", f"t{i}", ago(days=i), 0.5) for i in range(6)], [(i, 0, "text", None) for i in range(6)])
    seen = [(1, "u0", 5), (1, "u1", 4), (1, "u2", 3), (2, "u0", 1), (2, "u3", 9), (None, "u4", 2)]
    visits = spark.createDataFrame([(t, u, ago(hours=h)) for t, u, h in seen], "tenant_id long, url string, visited_at timestamp")
    lib = lib.with_tables(visits=visits)

    def ids(**limits):
        kept = L.enforce_retention(lib, scope="tenant", **limits)
        assert {r["document_id"] for r in kept.chunks.collect()} == (found := {r["document_id"] for r in kept.documents.collect()})
        return found

    assert ids(max_documents=1, max_chunks=9) == {2, 0, 4} and ids(max_documents=2, max_chunks=9) == {2, 1, 0, 3, 4}
    assert ids(max_documents=9, max_chunks=1) == {2, 0, 4} and ids(max_documents=9, max_chunks=9) == {0, 1, 2, 3, 4}
    with pytest.raises(ValueError):
        L.enforce_retention(lib, scope="domain")
