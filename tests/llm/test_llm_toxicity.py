import random

import numpy as np
from pyspark.sql import functions as F

from pagelens.llm import toxicity

BAD = ["vilean", "vileous", "grubby", "scoundrel"]


def corpus(n, seed):
    random.seed(seed)
    plain = [f"word{i}x" for i in range(120)]
    rows, labels = [], []
    for i in range(n):
        text = random.choices(plain, k=random.choice([3, 20, 200]))
        bad = i % 6 == 0
        if bad:
            text[random.randrange(len(text))] = random.choice(BAD) + random.choice(["", "!", "s"])
        # Labelled texts mention groups more often where they are toxic.
        if random.random() < (0.5 if bad else 0.05):
            text.append(random.choice(["women", "muslims", "gay"]))
        rows.append((i, " ".join(text), "en"))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_rows_and_neutral_mentions(spark):
    rows, labels = corpus(1500, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, known.filter(~toxicity.held_out(F.col("doc_id"))))
    got = toxicity.digest(toxicity.score(docs, model)).collect()
    truth = dict(labels)
    held = [r for r in got if r["held_out"]]
    assert 300 < len(held) < 700 and len(got) == 1500
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    for term in ("women", "muslims", "gay", "men", "christians"):
        assert abs(model.score(f"word1x word2x {term}") - model.score("word1x word2x")) < 0.1
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["score"] < toxicity.THRESHOLD}


def test_swaps_lessen_what_identity_terms_weigh():
    random.seed(2)
    # Column 0 marks toxic texts, 1 and 2 are terms of one kind, the first mostly in toxic texts.
    rows, y, swaps = [], [], []
    for _ in range(600):
        bad, term = random.random() < 0.5, None
        if random.random() < 0.6:
            term = 1 if random.random() < (0.9 if bad else 0.1) else 2
        own = ([0] if bad and random.random() < 0.8 else []) + ([term] if term else [])
        rows.append(own)
        y.append(int(bad))
        swaps.append([c if c == 0 else 3 - c for c in own] if term else None)
    _, free = toxicity.train(rows, np.array(y), [None] * len(rows), 3)
    _, fair = toxicity.train(rows, np.array(y), swaps, 3)
    assert abs(fair[1] - fair[2]) < 0.5 * abs(free[1] - free[2]) and fair[0] > 1


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "vile " * 50_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    got = toxicity.digest(toxicity.score(docs, model)).collect()
    assert len(got) == 4 and len({r["score"] for r in got}) == 1 and {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 1), (77, 0)], "doc_id long, toxic int")
    assert 0 <= toxicity.fit(docs, odd).score("x") <= 1
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_swapped_terms_are_of_the_same_kind():
    assert toxicity.swapped(["no", "term"], 1) is None
    new = toxicity.swapped(["the", "women", "said", "women"], 5)
    assert new[1] in {"men", "girls", "boys"} and new[1] == new[3] and new[0] == "the"


def loss_of(rows, labels, swaps, w, b):
    """The loss as it is stated, one row after the other."""
    total = {y: max(1, sum(x == y for x in labels)) for y in (0, 1)}
    out = toxicity.RIDGE / 2 * (w**2).sum() + toxicity.LASSO * np.abs(w).sum()
    pairs = [(a, s) for a, s in zip(rows, swaps, strict=True) if s is not None]
    for ones, y in zip(rows, labels, strict=True):
        z = w[ones].sum() + b
        out += 0.5 / total[y] * np.log1p(np.exp(-z if y else z))
    return out + toxicity.SWAPS * sum((w[a].sum() - w[s].sum()) ** 2 for a, s in pairs) / max(1, len(pairs))


def test_training_reaches_the_least_loss(monkeypatch):
    monkeypatch.setattr(toxicity, "SWAPS", 1.0)
    rng = np.random.default_rng(3)
    rows = [sorted(set(rng.integers(0, 6, 4).tolist())) for _ in range(60)]
    labels = np.array([int(rng.random() < (0.85 if 1 in r else 0.2)) for r in rows])
    swaps = [sorted({5 if i == 1 else i for i in r}) if k % 3 == 0 else None for k, r in enumerate(rows)]
    b, w = toxicity.train(rows, labels, swaps, 6)
    p, step = np.zeros(7), 1e-5
    for _ in range(1500):  # plain descent on differences
        base = loss_of(rows, labels, swaps, p[:6], p[6])
        slope = np.array([(loss_of(rows, labels, swaps, (p + step * e)[:6], (p + step * e)[6]) - base) / step for e in np.eye(7)])
        p -= 0.5 * slope
    assert loss_of(rows, labels, swaps, w, b) <= loss_of(rows, labels, swaps, p[:6], p[6]) * 1.002


def test_the_penalty_acts_on_the_given_tables(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    terms = [t for kind in toxicity.IDENTITIES for t in kind]

    def spread():
        model = toxicity.fit(docs, labels)
        assert model.pairs > 50
        own = [[model.weights.get(t, 0.0) for t in kind] for kind in toxicity.IDENTITIES]
        return sum(max(k) - min(k) for k in own), {t: model.weights.get(t, 0.0) for t in terms}

    held, with_penalty = spread()
    monkeypatch.setattr(toxicity, "SWAPS", 0.0)
    free, without = spread()
    assert with_penalty != without and free > 0 and held < 0.5 * free
