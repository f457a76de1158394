import random
import zlib

from pagelens.llm import sharding


def check(rows, texts, shards):
    sizes = [0] * shards
    for r in rows:
        sizes[r["shard"]] += r["size"]
        assert r["size"] == len((r["text"] or "").encode()) + 1 and r["law"] == "bytes"
    largest = max(len((t or "").encode()) + 1 for t in texts)
    assert max(sizes) - min(sizes) <= 2 * largest
    for shard in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))


def test_sizes_are_nearly_equal(spark):
    random.seed(7)
    texts = ["x" * int(random.paretovariate(0.9) * 20) for _ in range(800)] + ["é" * 400] * 500 + [None, None, ""]
    texts = [t[:20_000] if t else t for t in texts]
    docs = spark.createDataFrame([(i, t, 1, "clash") for i, t in enumerate(texts)], "doc_id long, text string, shard int, size string").repartition(6)
    for joined_by in (0, 10**6):
        rows = sharding.shard(docs, 8, broadcast_ranges=joined_by).collect()
        assert len(rows) == len(texts) and {r["doc_id"] for r in rows} == set(range(len(texts)))
        check(rows, texts, 8)
    digest = sharding.digest(sharding.shard(docs, 8)).filter("doc_id = 801").first()
    assert digest["text_crc32"] == zlib.crc32(("é" * 400).encode()) and digest["grown_shard"] is None


def test_one_shard_few_and_odd_rows(spark):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (2, "b" * 100_000)], schema)
    assert {r["shard"] for r in sharding.shard(docs, 1).collect()} == {0}
    check(sharding.shard(docs, 8).collect(), ["b" * 100_000], 8)
    assert sharding.shard(spark.createDataFrame([], schema), 8).count() == 0


def test_small_ranges_make_the_same_law(spark):
    docs = spark.createDataFrame([(i, "y" * (i % 50)) for i in range(2000)], "doc_id long, text string")
    check(sharding.shard(docs, 4, range_bytes=500).collect(), ["y" * 50], 4)


def test_repeated_rows_and_null_ids_keep_the_law(spark):
    random.seed(8)
    others = ["z" * random.randint(50, 400) for _ in range(400)]
    rows = [(None, "the same", 1)] * 800 + [(i, t, 1) for i, t in enumerate(others)] + [(5, "again", 1)] * 300
    for name in ("_no", "_h", "_parts", "other"):
        docs = spark.createDataFrame(rows, f"doc_id long, text string, {name} int").repartition(3)
        got = sharding.shard(docs, 8)
        assert name in got.columns and got.filter(f"{name} = 1").count() == len(rows)
        got = got.collect()
        check(got, others, 8)
        assert len({r["shard"] for r in got}) == 8
