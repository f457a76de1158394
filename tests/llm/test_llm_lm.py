import random
from collections import Counter

import numpy as np

from pagelens.llm import lm


def sentences(n, seed):
    random.seed(seed)
    nouns, verbs = [f"noun{i}" for i in range(20)], [f"verb{i}" for i in range(20)]
    return [" ".join(w for _ in range(12) for k in [random.randrange(20)] for w in ("the", nouns[k], verbs[k], "it")) for _ in range(n)]


def test_shuffled_texts_score_lower(spark, monkeypatch):
    # So small a corpus is learned from whole and in small steps.
    monkeypatch.setattr(lm, "SHARE", 1)
    monkeypatch.setattr(lm, "BATCH", 32)
    texts = sentences(600, 1)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words string").repartition(3)
    vocabulary, network = lm.fit(docs)
    fresh = sentences(40, 2)
    mixed = [" ".join(random.sample(t.split(), len(t.split()))) for t in fresh]
    given = spark.createDataFrame([(i, t) for i, t in enumerate(fresh + mixed)], "doc_id long, text string")
    got = {r["doc_id"]: r["mean_log_likelihood"] for r in lm.score(given, vocabulary, network).collect()}
    assert np.mean([got[i] > got[i + 40] + 0.1 for i in range(40)]) > 0.95
    untrained = lm.log_likelihoods(vocabulary(lm.hashed_words(fresh[0])), lm.Network()) / len(fresh[0].split())
    assert got[0] > untrained + 1


def test_words_of_all_places_are_learned(spark, monkeypatch):
    # Every text has the same word at the same place; the steps are small, the share of windows is the usual one.
    monkeypatch.setattr(lm, "BATCH", 32)
    text = " ".join(f"place{i}" for i in range(24))
    docs = spark.createDataFrame([(i, text) for i in range(800)], "doc_id long, text string").coalesce(1)
    vocabulary, network = lm.fit(docs)
    ids = vocabulary(lm.hashed_words(text))
    gained = network.log_probabilities(lm.contexts(ids), ids) - lm.Network().log_probabilities(lm.contexts(ids), ids)
    assert gained.min() > 5


def test_rare_words_have_their_share_of_a_shared_id(spark, monkeypatch):
    words = [f"often{i}" for i in range(lm.WORDS)]
    rare = [f"rare{i}" for i in range(400) for _ in range(1 + i % 3)]
    texts = [" ".join(words)] * 4 + [" ".join(rare[i::5]) for i in range(5)] + ["rare1 rare1 often5", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    vocabulary, network = lm.fit(docs)
    counts = Counter(w for t in texts for w in t.split())
    shared = Counter()
    for w, n in counts.items():
        shared[int(vocabulary(lm.hashed_words(w))[0])] += n
    fresh = [*texts, "rare3 never rare5 seen often1 rare5"]
    given = spark.createDataFrame([(7 if i < 2 else None if i == 2 else i, t) for i, t in enumerate(fresh)], "doc_id long, text string")
    wanted = []
    for d, t in [(r["doc_id"], r["text"]) for r in given.collect()]:
        ids = vocabulary(lm.hashed_words(t))
        total = lm.log_likelihoods(ids, network) if t else 0.0
        total += sum(np.log(counts.get(w, 1) / (shared[int(i)] + 1)) for w, i in zip(t.split(), ids, strict=True) if i >= lm.WORDS)
        wanted.append((d, len(ids), round(total, 1)))
    for bound in (500_000, 0):
        monkeypatch.setattr(lm, "BROADCAST_ROWS", bound)
        got = lm.score(given, vocabulary, network).collect()
        assert sorted(((r["doc_id"], r["n_words"]) for r in got), key=str) == sorted(((d, n) for d, n, _ in wanted), key=str)
        assert np.allclose(sorted(r["log_likelihood"] for r in got), sorted(x for _, _, x in wanted), atol=0.2)


def test_probabilities_sum_to_one_and_blocks_agree(monkeypatch):
    random_ = np.random.default_rng(0)
    network = lm.Network(lm.Network().flat * 5)
    ids = random_.integers(0, lm.EDGE, 40).astype(np.int32)
    around = lm.contexts(ids)
    for place in (0, 7, 39):
        every = np.arange(lm.CLASSES * lm.SIZE, dtype=np.int32)
        total = np.exp(network.log_probabilities(np.repeat(around[:, place : place + 1], len(every), axis=1), every)).sum()
        assert abs(total - 1) < 1e-3
    whole = lm.log_likelihoods(ids, network)
    monkeypatch.setattr(lm, "TOKENS", 7)
    assert abs(lm.log_likelihoods(ids, network) - whole) < 1e-3


def test_a_step_goes_down():
    ids = np.random.default_rng(1).integers(0, 50, 4000).astype(np.int32)
    around, network = lm.contexts(ids), lm.Network()
    before = network.log_probabilities(around, ids).mean()
    for _ in range(20):
        network.step(around, ids, 0.5)
    assert network.log_probabilities(around, ids).mean() > before + 0.3


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "word " * 150_000), (3, "one")], "doc_id long, text string")
    vocabulary, network = lm.fit(docs)
    got = sorted(((r["doc_id"], r["n_words"], r["mean_log_likelihood"] is None) for r in lm.score(docs, vocabulary, network).collect()), key=str)
    assert got == sorted([(1, 0, True), (1, 0, True), (None, 0, True), (2, 150_000, False), (3, 1, False)], key=str)
    vocabulary, network = lm.fit(docs.limit(0))
    assert lm.score(docs.limit(0), vocabulary, network).count() == 0


def test_many_texts_are_read_at_once_as_one_by_one():
    texts = ["The cat\tsat", None, "", " \n ", "x", "Ünder the über-long\x00 words  ", *sentences(5, 3)]
    words, sizes = lm.hashed_texts(texts)
    alone = [lm.hashed_words(t or "") for t in texts]
    assert sizes.tolist() == [len(a) for a in alone] and (words == np.concatenate(alone)).all()
    vocabulary = lm.Vocabulary(np.unique(words)[::2].view(np.int64).tolist())
    places = {w: i for i, w in enumerate(np.unique(words)[::2].tolist())}
    ids = vocabulary(words)
    assert ids.tolist() == [places.get(w, lm.WORDS + (w >> 7) % lm.RARE) for w in words.tolist()]
    each = np.split(ids, np.cumsum(sizes)[:-1])
    assert (lm.contexts(ids, sizes) == np.concatenate([lm.contexts(e) for e in each], axis=1)).all()
    # The rounds share the windows: each is in one of them, but a single one, which is in all.
    taken = [lm.share(sizes, turn) for turn in range(lm.ROUNDS)]
    assert (sum(t.astype(int) for t in taken) == np.where(np.repeat(sizes, sizes) == 1, lm.ROUNDS, 1)).all()
    assert (lm.contexts(ids, sizes, taken[1]) == lm.contexts(ids, sizes)[:, taken[1]]).all()


def test_counts_are_whole_however_few_a_task_holds(spark, monkeypatch):
    docs = spark.createDataFrame([(f"word{i % 7} Word{i % 5} rare{i}",) for i in range(600)] + [(None,), ("",)], "text string")
    wanted = Counter(w for i in range(600) for w in (f"word{i % 7}", f"word{i % 5}", f"rare{i}"))
    wanted = {int(lm.hashed_words(w).view(np.int64)[0]): n for w, n in wanted.items()}
    for bound in (1 << 20, 8):
        monkeypatch.setattr(lm, "COUNTS", bound)
        assert {r["word"]: r["n"] for r in lm.count_words(docs).collect()} == wanted


def test_a_step_is_the_gradient():
    random_ = np.random.default_rng(2)
    ids = random_.integers(0, lm.EDGE, 300).astype(np.int32)
    start = lm.Network().flat * 5
    network = lm.Network(start)
    network.step(lm.contexts(ids), ids, 1e-2)
    way = (network.flat - start).astype(float)
    loss = [-lm.log_likelihoods(ids, lm.Network(start + 20 * s * way)) / len(ids) for s in (-1, 1)]
    # Along the step, the loss falls by the rate times the squared length of the gradient.
    assert abs((loss[0] - loss[1]) / 40 - (way @ way) / 1e-2) < 0.02 * (way @ way) / 1e-2
