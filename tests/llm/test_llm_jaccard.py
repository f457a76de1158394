import random

import numpy as np

from pagelens.llm import components, jaccard


def brute_sets(text, width=3):
    w = [x for x in (text or "").encode().lower().split()]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(docs, percent=90):
    sets = [(d, brute_sets(t)) for d, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        low.setdefault(find(i), []).append(d)
    return sorted([(d, len(s), min([x for x in low[find(i)] if x is not None], default=None)) for i, (d, s) in enumerate(sets)], key=str)


def corpus(seed):
    random.seed(seed)
    words = [f"w{i}" for i in range(300)]
    common = random.choices(words, k=40)
    docs = []
    for group in range(6):
        base = random.choices(words, k=random.choice([4, 30, 120]))
        for _ in range(60 if group == 0 else 8):
            copy = list(base)
            for _ in range(random.randint(0, 3)):
                copy[random.randrange(len(copy))] = random.choice(words)
            docs.append(" ".join(copy))
    docs += [" ".join(common + random.choices(words, k=random.randint(0, 12))) for _ in range(50)]
    docs += [docs[3]] * 40 + ["", None, " \n", "one", "ONE", "one two", "É a b c", "é a b c", "A B C"]
    random.shuffle(docs)
    return [(i, d) for i, d in enumerate(docs)]


def test_like_brute_force(spark, monkeypatch):
    for seed, paired, meeting in ((1, 32, 24 << 20), (2, 2, 1 << 12)):  # the second: many meetings, cut into parts
        monkeypatch.setattr(jaccard, "PAIRED", paired)
        monkeypatch.setattr(jaccard, "MEETING_BYTES", meeting)
        docs = corpus(seed)
        docs += [docs[0], docs[0]]
        given = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, set string").repartition(3)
        got = sorted(((r[0], r[1], r[2]) for r in jaccard.near_duplicates(given).collect()), key=str)
        assert got == brute(docs)


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    docs = corpus(3)
    given = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(((r[0], r[1], r[2]) for r in jaccard.near_duplicates(given).collect()), key=str) == brute(docs)


def test_one_of_each_group_stays(spark):
    rows = [(4, "a b c d", "x"), (2, "a b c d", "y"), (9, "other words here", "z"), (9, "other words here", "z"), (5, None, None), (6, "", "q"), (None, "lone text of null", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, set string")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]) for r in kept.collect())) == ["2", "5", "6", "9", "None"]
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_null_and_repeated_ids_are_decided_by_text(spark, monkeypatch):
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(1, near, "first"), (None, near + " end", "copy"), (None, "a text of its own", "lone"), (None, "and one more text", "more"), (None, "AND one more text", "again"),
            (3, near.upper(), "copy"), (3, "the other text of three", "other"), (4, "one text of four", "one"), (4, "another text of four", "two"), (4, "One text of four", "repeat"),
            (7, near + " last", "copy"), (8, None, "empty"), (8, "", "empty"), (8, "words of eight", "eight"), (None, None, "none"), (None, " ", "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, set string").repartition(3)
    for bound in (500_000, 0):
        monkeypatch.setattr(jaccard, "BROADCAST_ROWS", bound)
        kept = jaccard.keep_one(docs)
        assert kept.columns == docs.columns
        got = sorted((str(r["doc_id"]), " ".join((r["text"] or "").lower().split()[:5])) for r in kept.collect())
        wanted = [("1", "w0 w1 w2 w3 w4"), ("3", "the other text of three"), ("4", "another text of four"), ("4", "one text of four"), ("8", ""), ("8", "words of eight"),
                  ("None", ""), ("None", ""), ("None", "a text of its own"), ("None", "and one more text")]
        assert got == wanted


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, 1 << jaccard.CELL_BITS).astype(np.uint32)
    for _ in range(300):
        n = int(rng.integers(2, 200))
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        other = base.copy()
        other[: rng.integers(0, max(1, n // 15) + 1)] += np.uint64(1)
        a, b = np.unique(base), np.unique(other)
        if jaccard.similar(len(np.intersect1d(a, b)), len(a), len(b), 90):
            for x, y in zip(jaccard.prefixes(a, counts, 90), jaccard.prefixes(b, counts, 90), strict=True):
                assert len(np.intersect1d(x, y))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (5, 4)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}}


def test_sums_of_powers_do_not_make_sets_alike(spark):
    from test_llm_packing import thue_morse

    a, b = thue_morse(11)
    rows = [(1, f"x {a} y"), (2, f"x {b} y"), (3, f"{a} {b} z"), (4, f"{b} {a} z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r[0], r[2]) for r in jaccard.near_duplicates(docs).collect()) == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_clashing_names(spark):
    rows = [(1, "a b c", 5), (2, "A b c", 6), (3, "other words here", 7), (3, "some more of them", 8)]
    for name in ("_gone", "_set", "_apart"):
        docs = spark.createDataFrame(rows, f"doc_id long, text string, {name} int")
        for given, kept in ((docs, [5, 7, 8]), (docs.filter(f"{name} != 8"), [5, 7])):
            out = jaccard.keep_one(given)
            assert out.columns == docs.columns and sorted(r[2] for r in out.collect()) == kept
