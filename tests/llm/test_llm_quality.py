import random

import numpy as np
from pyspark.sql import functions as F

from pagelens.llm import quality, toxicity
from pagelens.llm.queries import graded


def test_expected_grades_follow_the_ratings(spark):
    random.seed(3)
    rows, ratings = [], []
    for i in range(900):
        grade = i % 4
        words = [random.choice(["fine", "good", "clear"]) if random.random() < 0.15 + 0.2 * grade else random.choice(["spam", "buy", "***"]) for _ in range(40)]
        rows.append((i, " ".join(words), 0))
        ratings.append((i, grade))
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = quality.fit(docs, spark.createDataFrame([r for r in ratings if r[0] % 3], "doc_id long, quality int"))
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in quality.rate(docs, model, at_least=2).collect()}
    held = [(g, got[i]["expected_grade"]) for i, g in ratings if i % 3 == 0]
    means = [np.mean([e for g, e in held if g == k]) for k in range(4)]
    assert means == sorted(means) and np.mean([abs(g - e) for g, e in held]) < 0.6
    tails = [(g >= 2, got[i]["tail_probability"] >= 0.5) for i, g in ratings if i % 3 == 0]
    assert np.mean([a == b for a, b in tails]) > 0.85


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "", "y"), (2, "word " * 100_000, None)], "doc_id long, text string, expected_grade string")
    for ratings in ([], [(None, 1), (1, None), (2, 1), (99, 0)], [(1, 0), (2, 1)]):
        model = quality.fit(docs, spark.createDataFrame(ratings, "doc_id long, quality int"))
        got = quality.rate(docs, model).collect()
        assert len(got) == 4 and all(0 <= r["tail_probability"] <= 1 for r in got)
    assert quality.rate(docs.limit(0), model).count() == 0


def loss_of(rows, grades, w, t):
    out = quality.RIDGE / 2 * (w**2).sum()
    for (columns, values), g in zip(rows, grades, strict=True):
        above = [1.0, *(1 / (1 + np.exp(-(w[columns] @ values - t)))), 0.0]
        out -= np.log(above[g] - above[g + 1]) / len(rows)
    return out


def test_training_reaches_the_least_loss():
    rng = np.random.default_rng(4)
    grades = np.array([i % 3 for i in range(60)])
    rows = [(np.array([g, 3 + int(rng.integers(0, 3))]) if rng.random() < 0.7 else np.array([3, 4]), np.array([0.8, 0.6])) for g in grades]
    model = quality.train(rows, grades, 2)
    p, step = np.array([0.0] * 6 + [-0.5, 0.5]), 1e-5
    for _ in range(2500):
        base = loss_of(rows, grades, p[:6], p[6:])
        slope = np.array([(loss_of(rows, grades, (p + step * e)[:6], (p + step * e)[6:]) - base) / step for e in np.eye(8)])
        p -= 1.0 * slope
    least = loss_of(rows, grades, p[:6], p[6:])
    assert loss_of(rows, grades, model.weights[:6].astype(float), model.thresholds) <= least * 1.02, least


def test_three_grades_of_the_given_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    ratings = graded(labels)
    held = toxicity.held_out(F.col("doc_id"))
    model = quality.fit(docs, ratings.filter(~held), grade="grade")
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    got = quality.rate(docs, model, at_least=2).join(ratings.filter(held), "doc_id").filter("grade is not null").collect()
    means = [np.mean([r["expected_grade"] for r in got if r["grade"] == g]) for g in (0, 1, 2)]
    taken = [np.mean([r["tail_probability"] >= 0.5 for r in got if r["grade"] == g]) for g in (0, 2)]
    assert means == sorted(means) and taken[0] < 0.15 and taken[1] > 0.98, (means, taken)
