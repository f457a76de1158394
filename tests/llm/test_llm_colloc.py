import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pagelens.llm import colloc


def brute(rows, least, first, percent=100, longest=5):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            score, _, cut = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, (counts[p[:k]], counts[p[k:]])) for k in range(1, len(p)))
            around = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= percent * a for b in around):
                kept.append((-score, -a, " ".join(p).encode(), cut))
        for rank, (score, a, p, (left, right)) in enumerate(sorted(kept)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = ["the", "of", "Zug", "ÉCOLE", "école", "x", "a-b", "longerthanseven", "eightbyt", "…"] + [f"r{i}" for i in range(200)]
    rows = []
    for _ in range(n):
        picked = rng.choices(words, weights=[40, 30, 9, 9, 9, 9, 9, 20, 20, 9] + [0.2] * 200, k=rng.randint(0, 30))
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!? "]) for w in picked)
        rows.append((text + rng.choice(["", "the quick brown fox jumps over", "Of The ZUG"]), rng.choice(["en", "en", "de", None, "und"])))
    return rows + [(None, "en"), ("", "en"), (" .,", None), ("the the the the the the the", "fr")] + [("one two three four five six", "fr")] * 30


def found(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("how", [{}, {"vocabulary_rows": 3}, {"pair_rows": 2}, {"percent": 60}])
def test_like_brute_force(spark, how, monkeypatch):
    if how.get("percent"):
        monkeypatch.setattr(colloc, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(colloc, "BLOCK_BYTES", 50)
    rows = corpus(len(how) + 3)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, w1 string, n int").repartition(3)
    expected = brute(rows, 12, 25, how.get("percent", 100))
    assert len({r[0] for r in expected}) == 4 and max(len(r[2].split(" ")) for r in expected) >= 4
    assert found(colloc.collocations(docs, least=12, first=25, **how)) == expected


def test_products_beyond_64_bits(spark):
    big = 10**16
    phrases = spark.createDataFrame([("en", [1], big + 3), ("en", [2], big + 1), ("en", [1, 2], big), ("en", [1, 2, 1], 7)], "lang string, phrase array<long>, f long")
    totals = spark.createDataFrame([("en", 9 * big + 7)], "lang string, n long")
    got = {tuple(r["phrase"]): (r["l"], r["r"], r["score"]) for r in colloc.scored(phrases.filter("size(phrase) < 3"), totals).collect()}
    assert got == {(1, 2): (big + 3, big + 1, 1000 * big * (9 * big + 7) // ((big + 3) * (big + 1)))}


def test_windows_end_where_no_phrase_goes_on():
    words, pieces = np.array([1, 2, 0, 3, 3, 1, 2, 2]), np.array([0, 0, 0, 0, 0, 0, 1, 1])
    assert [c.tolist() for c in colloc.leads(words, pieces, 3)] == [[1, 2, 3, 3, 1, 2, 2], [2, 0, 3, 1, 0, 2, 0], [0, 0, 1, 0, 0, 0, 0]]
    known = np.sort(colloc.pair(np.array([3, 2]), np.array([1, 2])))
    assert [c.tolist() for c in colloc.leads(words, pieces, 3, known)] == [[1, 2, 3, 3, 1, 2, 2], [0, 0, 0, 1, 0, 2, 0], [0] * 7]
    for few in ([], [5]):
        assert [len(c) for c in colloc.leads(np.array(few, dtype=np.int64), np.array(few, dtype=np.int64))] == [len(few)] * 5


def test_no_words(spark):
    docs = spark.createDataFrame([(None, "en"), ("", None), ("some few words", "en")], "text string, lang string")
    assert found(colloc.collocations(docs)) == [] and found(colloc.collocations(docs.limit(0))) == []


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(colloc, "BLOCK_BYTES", 7)
    text = b"one two three. four five, six seven eight nine ten\nend"
    cut = list(colloc.parts(text))
    assert b"".join(cut) == text and len(cut) > 2 and all(p[-1:] in b".,\n" for p in cut[:-1])


@pytest.mark.parametrize("limit", [10**6, 4])
def test_windows_of_a_tasks_blocks_are_added_up(monkeypatch, limit):
    monkeypatch.setattr(colloc, "BLOCK_BYTES", 16)
    monkeypatch.setattr(colloc, "HELD_ROWS", limit)
    texts = [("en", "one two three. one two"), ("de", "one two"), ("en", "one two three"), ("en", ". ,"), ("de", "one two")] * 6
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*texts, strict=True)], ["lang", "text"])
    rows = [tuple(r.values()) for out in colloc.held_windows(iter([batch]), None, None) for r in out.to_pylist()]
    sums, want = Counter(), Counter()
    for *window, n in rows:
        sums[tuple(window)] += n
    one, two, three = (int(colloc.places(w)[0].view(np.int64)[0]) for w in (b"one", b"two", b"three"))
    for lang, words, n in [("en", (one, two, three), 12), ("en", (two, three), 12), ("en", (three,), 12), ("en", (one, two), 6), ("en", (two,), 6), ("de", (one, two), 12), ("de", (two,), 12)]:
        want[lang, *words, *[0] * (5 - len(words))] = n
    assert sums == want
    if limit > 100:
        assert len(rows) == len(sums)
