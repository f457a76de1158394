import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from pagelens.llm import variants

SF = "/root/testdata/sf0.001"


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near, holes = defaultdict(set), defaultdict(list)
    for w in n:
        for i in range(len(w)):
            holes[w[:i] + "\0" + w[i + 1 :]].append(w)
            if w[:i] + w[i + 1 :] in n:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for group in holes.values():
        for w in group:
            near[w].update(v for v in group if v != w)
    forms = {}
    for w, own in near.items():
        if own:
            best = min(own, key=lambda v: (-n[v], v))
            if n[best] >= 2 * n[w]:
                forms[w] = best
    out = []
    for w, c in n.items():
        root = w
        while root in forms:
            root = forms[root]
        form = forms.get(w)
        out.append((w, form, root, c, len(near[w]), n[form] if form else None))
    return sorted(out, key=str)


def found(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    stems = ["abcde", "abcdef", "straße", "ÉCOLES", "écoles", "aaaaaaaa", "x" * 60, "language", "Ünïcode", "edcba"]
    docs = []
    for i in range(300):
        picked = []
        for _ in range(rng.randint(0, 40)):
            w = rng.choice(stems)
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abé") + w[at:], w[:at] + rng.choice("abé") + w[at + 1 :]])
            picked.append(w)
        docs.append((i, "".join(w + rng.choice([" ", "-", "1", "ž", ". ", "×"]) for w in picked)))
    return docs + [(None, "straße straße strasse"), (None, None), (7, ""), (7, "language " * 30), (7, "language " * 30)]


def test_like_brute_force(spark, monkeypatch):
    for seed in (1, 2):
        docs = corpus(seed)
        given = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, n int").repartition(3)
        expected = brute(docs)
        assert len({r[1] for r in expected}) > 5 and max(r[4] for r in expected) > 3
        assert found(variants.variants(given)) == expected
        # The second: blocks in many parts, no broadcasts.
        for name, value in (("RESIDENTS", 3), ("VISITORS", 4), ("BROADCAST_ROWS", 0)):
            monkeypatch.setattr(variants, name, value)


def test_documents_of_the_smallest_scale(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(variants.variants(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_long_words_and_no_words(spark):
    long = "ab" * 3000
    docs = [(i, f"{long} {long[1:]} {long[:-1]}c short") for i in range(3)]
    assert found(variants.variants(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)
    assert found(variants.variants(spark.createDataFrame([(1, None), (2, "few words")], "doc_id long, text string"))) == []


def test_ways_of_many_steps(spark):
    rows = [(f"w{i:02}", f"w{i + 1:02}") for i in range(40)] + [("w90", "w91"), ("w95", "w39"), ("w99", None)]
    got = {r["word"]: r["root"] for r in variants.roots(spark.createDataFrame(rows, "word string, form string")).collect()}
    assert got == {f"w{i:02}": "w40" for i in range(40)} | {"w90": "w91", "w95": "w40"}


def test_all_pairs_in_parts(monkeypatch):
    rng = random.Random(5)
    texts = sorted({"".join(rng.choices("abc", k=rng.choice([4, 5]))) for _ in range(200)})
    codes = np.frombuffer("".join(texts).encode("latin-1"), np.uint8)
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes) - sizes
    monkeypatch.setattr(variants, "ROWS", 7)
    monkeypatch.setattr(variants, "COLUMNS", 5)
    monkeypatch.setattr(variants, "PART_BYTES", 20)
    five, four = np.flatnonzero(sizes == 5), np.flatnonzero(sizes == 4)
    got = set()
    for other, less in ((five, 0), (four, 1)):
        for at, to in variants.near_pairs(codes, starts[five], 5, starts[other], np.ones(len(other), bool), less):
            pairs = [(texts[five[x]], texts[other[y]]) for x, y in zip(at, to, strict=True)]
            assert not got & set(pairs)
            got.update(pairs)
    expected = {frozenset((a, b)) for a in texts for b in texts if len(a) == 5 and a != b and one_apart(a, b)}
    assert {frozenset(p) for p in got} == expected and len(got) == len(expected)
