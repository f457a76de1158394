import random
from datetime import timedelta

from helpers import NOW, ago
from pyspark.sql import functions as F

from pagelens.operators import activity as A
from pagelens.operators.spread import number_rows


def calls(spark, rows):
    return spark.createDataFrame([(k, NOW + timedelta(seconds=s), i) for i, (k, s) in enumerate(rows)],
                                 "key string, ts timestamp, call_id long")


def by_hand(rows, limit, window=60):
    admitted, out = {}, {}
    for i, (k, s) in sorted(enumerate(rows), key=lambda x: (x[1][1], x[0])):
        recent = [t for t in admitted.get(k, []) if s - t < window]
        out[i] = len(recent) < limit
        admitted[k] = recent + [s] if out[i] else recent
    return out


def allowed(df):
    return {r["call_id"]: r["allowed"] for r in df.collect()}


def test_limits_follow_the_window(spark):
    rows = [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 3), ("a", 61)]
    assert allowed(A.rate_limit(calls(spark, rows), "key", 3)) == {0: True, 1: True, 2: True, 3: False, 4: True, 5: True}


def test_limits_equal_deciding_one_call_at_a_time(spark):
    rng = random.Random(7)
    rows = [(rng.choice("aaab"), rng.choice([0, 4_000, 7_000]) + rng.randint(0, 700)) for _ in range(1_500)]
    for limit in (1, 5):
        assert allowed(A.rate_limit(calls(spark, rows), "key", limit)) == by_hand(rows, limit)


def test_a_key_that_never_pauses_is_decided_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(A, "PIECE", 4)
    monkeypatch.setattr(A, "LONG", 50)
    rng = random.Random(8)
    rows, at = [], 0
    for _ in range(900):  # for hours no pause of a minute; sometimes few calls, sometimes many
        at += rng.choice([1, 2, 5, 20, 45]) if at % 1000 < 700 else rng.choice([25, 50, 59])
        rows.append(("a", at))
    rows += [("b", s) for s in range(0, 3_000, 7)] + [("c", s) for s in range(0, 3_000, 30)] + [("d", 5), ("d", 6)]
    for limit in (3, 9):
        given = calls(spark, rows)
        assert allowed(A.rate_limit(given, "key", limit)) == by_hand(rows, limit)
    # Pieces agree after some rounds, or else the run goes through one task.
    timed = given.withColumns({"_run": F.col("key"), "_ms": F.unix_millis("ts")}).withColumn("_piece", F.floor(F.col("_ms") / 240_000))
    carried, unsettled = A.settled(timed, 9, 60_000, "call_id", rounds=2)
    assert carried.count() > 60 and {r["_run"] for r in unsettled.collect()} < {"a", "b", "c", "d"}
    assert A.settled(timed, 9, 60_000, "call_id", rounds=99)[1].count() == 0
    monkeypatch.setattr(A, "ROUNDS", 1)
    assert allowed(A.rate_limit(given, "key", 3)) == by_hand(rows, 3)


def test_idle_capture_waits_for_quiet(spark):
    rows = [("a", 0), ("a", 2), ("a", 10), ("a", 14), ("b", 3)]
    got = A.idle_capture(calls(spark, rows), "key", 5, "call_id")
    assert sorted(r["call_id"] for r in got.collect()) == [1, 3, 4]


def test_null_keys_and_times_are_decided_too(spark):
    rows = [(i, None if i % 2 else "a", ago(seconds=100 - i)) for i in range(12)] + [(50, "a", None), (51, None, None)]
    calls = spark.createDataFrame(rows, "call_id long, key string, ts timestamp")
    got = {r["call_id"]: r["allowed"] for r in A.rate_limit(calls, "key", 4).collect()}
    assert got == {i: i < 8 for i in range(12)} | {50: False, 51: False}
    last = A.idle_capture(calls, "key", 30, "call_id").collect()
    assert sorted(r["call_id"] for r in last) == [10, 11]
    every = number_rows(calls.withColumn("day", F.to_date("ts")), ["key"], "day", [F.col("ts"), F.col("call_id")], "n")
    assert sorted(r["n"] for r in every.collect()) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7]


def test_rate_limits_read_what_was_numbered_once(spark, tmp_path):
    rows = [(i, f"k{i % 3}", ago(seconds=i)) for i in range(90)]
    spark.createDataFrame(rows, "call_id long, key string, ts timestamp").write.parquet(str(tmp_path / "calls"))
    plan = A.rate_limit(spark.read.parquet(str(tmp_path / "calls")), "key", 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") <= 8 and "Window" not in plan


def test_sketches_of_days_unite(spark):
    rows = [(f"u{i % 700}", f"h{i % 3}.test", NOW + timedelta(days=i % 20)) for i in range(9_000)]
    visits = spark.createDataFrame(rows, "url string, hostname string, visited_at timestamp")
    daily = A.daily_sketches(visits)
    got = A.sketched_counts(daily.withColumn("all", F.lit(1)), ["all"]).first()
    assert got["visits"] == 9_000 and abs(got["pages"] - 700) < 0.05 * 700
    per = {r["domain"]: r["pages"] for r in A.sketched_counts(daily.filter("day < '2023-11-20'"), ["domain"]).collect()}
    exact = {h: len({u for u, host, at in rows if host == h and at.date().isoformat() < "2023-11-20"}) for h in per}
    assert len(per) == 3 and all(abs(per[h] - n) <= 1 + 0.06 * n for h, n in exact.items())
