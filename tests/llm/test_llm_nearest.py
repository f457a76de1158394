import numpy as np
from pyspark.sql import functions as F

from pagelens.llm import nearest


def brute(ids, vectors, asking, k):
    out = {}
    for q in asking:
        score = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, score)) if ids[i] != ids[q]][:k]
        out[ids[q]] = [(ids[i], score[i]) for i in order]
    return out


def test_recall_and_exact_scores(spark):
    random = np.random.default_rng(1)
    centres = random.normal(size=(12, 24))
    vectors = (centres[random.integers(0, 12, 2500)] + 0.6 * random.normal(size=(2500, 24))).astype(np.float32).astype(float)
    vectors[500:1300] = vectors[500]  # a third are one vector
    ids = np.arange(2500) * 5
    given = spark.createDataFrame([(int(i), v.tolist(), 1, "clash") for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<float>, rank int, score string")
    rows = nearest.nearest(spark, given, F.col("vec_id") % 100 == 0, 10).collect()
    want = brute(ids, vectors, [i for i in range(2500) if ids[i] % 100 == 0], 10)
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * 10 * len(want)
    place = {int(i): n for n, i in enumerate(ids)}
    for q, found in got.items():
        assert found == sorted(found, key=lambda f: (f[1], f[0]))
        assert all(abs(np.sqrt(((vectors[place[i]] - vectors[place[q]]) ** 2).sum()) - s) < 1e-12 for i, s in found)
    assert [i for i, _ in got[2600]] == [i for i, _ in want[2600]]  # ties among copies go to smaller ids


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.1]), (1, [1.0, None]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
            (6, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (7, []), (0, [1.0, 0.0]), (8, [3.0, 0.0])]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in nearest.nearest(spark, given, F.col("vec_id") % 100 == 0, 10).collect())
    assert got == [(0, 1, 100), (0, 2, 8), (100, 1, 0), (100, 2, 8)]
    assert nearest.nearest(spark, given.limit(0), F.lit(True), 10).count() == 0


def test_every_code_within_the_radius_is_found():
    random = np.random.default_rng(2)
    codes = random.integers(0, 256, (3000, 4), dtype=np.uint8)
    slab = nearest.Slab.unpacked(nearest.Slab.of([[i] for i in range(3000)], codes.astype(float), codes).packed())
    for radius in range(0, 33, 3):
        code = random.integers(0, 256, 4, dtype=np.uint8)
        rows, distance = slab.within(code, radius)
        want = np.unpackbits(codes ^ code, axis=1).sum(axis=1)
        assert (rows == np.flatnonzero(want <= radius)).all() and (distance == want[rows]).all()


def test_no_query_takes_part(spark):
    given = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.1]), (100, [0.0, 0.0]), (200, None)], "vec_id long, embedding array<float>")
    got = nearest.nearest(spark, given, F.col("vec_id") % 100 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and got.count() == 0
