import random
import re

from pyspark.sql import functions as F

from pagelens.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans(decontam.UPPER, decontam.LOWER)


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items, width):
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, passage in items:
            p = words(passage)
            size = min(width, len(p))
            windows = {tuple(p[i : i + size]) for i in range(len(p) - size + 1)} if size else set()
            for i in range(len(w) - size + 1 if size else 0):
                if tuple(w[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    found.add(str(item))
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def found(rows):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in rows.collect()), key=str)


def test_like_brute_force(spark):
    random.seed(8)
    vocabulary = ["the", "of", "École", "a1", "Zug", "x", "y", "z", "ß", "longer"]
    items = [(i, " ".join(random.choices(vocabulary, k=random.choice([1, 2, 3, 5, 9, 90])))) for i in range(12)] + [(50, None), (51, "..."), (3, "the x")]
    docs = []
    for i in range(80):
        text = random.choices(vocabulary, k=random.randint(0, 60))
        for _ in range(random.randint(0, 2)):
            p = words(random.choice(items)[1])
            start = random.randint(0, max(0, len(p) - 3))
            text[random.randint(0, len(text)):0] = p[start : start + random.randint(2, 8)]
        docs.append((i, random.choice([" ", ", ", "--"]).join(text)))
    docs += [(90, None), (91, ""), (None, "the the the the"), (5, docs[5][1]), (5, "another text with id five")]
    given = spark.createDataFrame([(*d, 1, "clash") for d in docs], "doc_id long, text string, pos int, term string").repartition(4)
    tests = spark.createDataFrame([(*x, 2) for x in items], "item_id long, text string, doc_id int")
    for rows in (0, 10**6):
        assert found(decontam.report(given, tests, 4, rows)) == brute(docs, items, 4)


def test_case_and_accents_outside_ascii_matter(spark):
    docs = spark.createDataFrame([(1, "ÉCOLE deux TROIS"), (2, "École deux trois"), (3, "école deux trois")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "École Deux trois")], "item_id long, text string")
    assert [(r[0], r[2]) for r in found(decontam.report(docs, items, 3))] == [(1, 3), (2, 3), (3, 0)]  # only A-Z change: É stays É


def test_clean_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d", "en"), (2, "q a b c", "en"), (3, None, None), (None, "b c", "x"), (2, "other words", "y")], "doc_id long, text string, copy string")
    items = spark.createDataFrame([(7, "a b c")], "item_id long, text string")
    kept = decontam.clean(docs, items, 3)
    assert kept.columns == docs.columns and sorted(map(str, (tuple(r)[:2] for r in kept.collect()))) == sorted(map(str, [(3, None), (None, "b c"), (2, "other words")]))
    assert decontam.report(docs.limit(0), items, 3).count() == 0
    assert {r["n_hit"] for r in decontam.report(docs, items.limit(0), 3).collect()} == {0}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "c x b y a"), (2, "a " + "x " * 20 + "b c"), (3, "b a")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c")], "item_id long, text string")
    index = decontam.build_index(docs)
    assert {r["doc_id"] for r in decontam.near(index, items, 4, 3).collect()} == {1}
    assert {r["doc_id"] for r in decontam.near(index, items, 30, 3).collect()} == {1, 2}


def test_rows_without_an_id_are_told_apart(spark):
    # Two texts alike under Spark's 32-bit hash, one of them with the passage.
    seen, pair = {}, None
    for n, text in enumerate(f"{'a b c' if i % 2 else 'c b a'} {i}" for i in range(200_000)):
        seen.setdefault(n % 2, []).append(text)
    texts = spark.createDataFrame([(t,) for t in seen[0] + seen[1]], "text string")
    by_hash = texts.selectExpr("hash(text) AS h", "text").groupBy("h").agg(F.collect_set("text").alias("t")).filter("size(t) > 1")
    pair = next(r["t"] for r in by_hash.collect() if len({t[0] for t in r["t"]}) == 2)
    rows = [(None, t, k) for k, t in enumerate(pair)] + [(7, "a b c", 8), (7, "words", 9)]
    items = spark.createDataFrame([(7, "a b c")], "item_id long, text string")
    for names in ("_doc", "_row", "copy"):
        docs = spark.createDataFrame(rows, f"doc_id long, text string, {names} int")
        kept = decontam.clean(docs, items, 3)
        assert kept.columns == docs.columns
        assert sorted(r["text"] for r in kept.collect()) == sorted(["words", next(t for t in pair if t[0] == "c")])
    assert sorted(r["n_hit"] for r in decontam.report(docs, items, 3).collect()) == [0, 0, 3, 3]
