"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every word is predicted from the words on both sides of it. The network adds an embedding per place and
context word, squashes the sum, and gives the word's probability as that of its class times that of the
word within the class. It is trained in numpy where the documents lie: each task goes down the gradient
over its windows, dealt over the rounds so that every one is used, and the tasks' weights are averaged
by the windows behind them after each round. Words without an id of their own share one by their hash; such a word has the share of its
id's probability that it has of the id's occurrences in the corpus, from the table of all counts. Scores
are sums of the conditional log probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import discard, slices, stored, tidied
from pagelens.llm.fingerprints import of_ranges

#: Words with an id of their own; all others share the last ids by their hash. Classes of equal size.
WORDS, RARE, CLASSES = 960, 63, 32
#: One id more for the edge of a text. Width of the hidden layer, words on each side.
EDGE, WIDTH, REACH = WORDS + RARE, 24, 2
SIZE = (EDGE + 1) // CLASSES
#: Rounds of averaging; step and windows of a step.
ROUNDS, RATE, BATCH = 2, 0.5, 2048
#: A round trains on every ``SHARE``-th window, the next one from another offset on: together on all of them.
SHARE = ROUNDS
#: Tokens that are scored together; so few that what is computed of them stays in a core's cache.
TOKENS = 1 << 13
#: Counts of words that a task holds before those of one word are added up; half as many left are handed on.
COUNTS = 1 << 20
#: Rows of the table of rare words' counts that are sent to all executors; more are joined by a shuffle.
BROADCAST_ROWS = 500_000

LOWER = np.array([c | 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: Where the numbers of an id's embedding lie.
ROWS = np.arange((EDGE + 1) * WIDTH).reshape(EDGE + 1, WIDTH)
PLACES = [p for p in range(-REACH, REACH + 1) if p]


def hashed_texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words between blanks of some texts, A-Z lower-cased, and how many words each text has."""
    raw = [(t or "").encode() for t in texts]
    ends_of = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    full = np.concatenate([[False], data > 32])
    edges = np.flatnonzero(full[1:] != full[:-1])  # the last byte is a blank, so every word has an end
    starts, ends = edges[::2], edges[1::2]
    return of_ranges(LOWER[data], starts, ends), np.diff(np.searchsorted(starts, ends_of), prepend=0)


def hashed_words(text: str) -> np.ndarray:
    """Fingerprints of the words of one text."""
    return hashed_texts([text])[0]


class Vocabulary:
    """Ids of words by their fingerprints: the most frequent words first, in classes of like frequency.

    ``rare`` has ``counted, log_n`` of the words that share an id and were counted more than once; ``shared``
    how many occurrences each shared id has. One more is left for all words that were never counted.
    """

    def __init__(self, frequent: list[int], rare: DataFrame | None = None, shared: dict[int, int] | None = None):
        self.rare = rare
        self.log_shared = np.log([1.0 + (shared or {}).get(i, 0) for i in range(RARE)])
        found = np.array(frequent[:WORDS], np.int64).view(np.uint64)
        order = np.argsort(found)
        self.hashes, self.ids = found[order], order.astype(np.int32)
        # Where the fingerprints with the same highest bits begin, and how many there are at most.
        buckets = (self.hashes >> np.uint64(48)).astype(np.int64)
        self.firsts = np.searchsorted(buckets, np.arange(1 << 16)).astype(np.int32)
        self.most = int(np.bincount(buckets).max()) if len(buckets) else 0

    def __call__(self, words: np.ndarray) -> np.ndarray:
        out = (WORDS + (words >> np.uint64(7)) % np.uint64(RARE)).astype(np.int32)
        firsts = self.firsts[words >> np.uint64(48)]
        for i in range(self.most):
            at = np.minimum(firsts + i, len(self.hashes) - 1)
            out = np.where(self.hashes[at] == words, self.ids[at], out)
        return out

    def __getstate__(self) -> dict:
        """What tasks need; the table stays with the driver."""
        return {**self.__dict__, "rare": None}


class Network:
    def __init__(self, weights: np.ndarray | None = None):
        shapes = [(len(PLACES), EDGE + 1, WIDTH), (WIDTH,), (CLASSES, WIDTH), (CLASSES,), (CLASSES, SIZE, WIDTH), (CLASSES, SIZE)]
        total = sum(int(np.prod(s)) for s in shapes)
        if weights is None:
            random = np.random.default_rng(3)
            weights = random.normal(0, 0.1, total).astype(np.float32)
        self.flat, parts, at = np.array(weights, np.float32), [], 0
        for s in shapes:
            parts.append(self.flat[at : at + int(np.prod(s))].reshape(s))
            at += int(np.prod(s))
        self.embed, self.bias, self.group, self.group_bias, self.word, self.word_bias = parts

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """A row for each window, and a last column of ones for the biases."""
        out = np.ones((context.shape[1], WIDTH + 1), np.float32)
        total = np.take(self.embed[0], context[0], axis=0) + self.bias
        for place, ids in zip(self.embed[1:], context[1:], strict=True):
            total += np.take(place, ids, axis=0)
        np.tanh(total, out=out[:, :WIDTH])
        return out

    def logits(self, h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the classes and of the words within each window's class, a column for each window; the words' weights with biases.

        Windows are sorted by class; those of class ``g`` lie between ``ends[g]`` and ``ends[g + 1]``.
        """
        groups = np.concatenate([self.group, self.group_bias[:, None]], axis=1) @ h.T
        weights = np.concatenate([self.word, self.word_bias[:, :, None]], axis=2)
        words = np.empty((SIZE, len(h)), np.float32)
        for g, (start, end) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if start < end:
                words[:, start:end] = weights[g] @ h[start:end].T
        return groups, words, weights

    def log_probabilities(self, context: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Of each id, given the ids around it (a row of ``context`` for each place)."""
        order, ends, at = *_by_class(ids), np.arange(len(ids))
        ids = ids[order]
        groups, words, _ = self.logits(self.hidden(np.take(context, order, axis=1)), ends)
        out = np.empty(len(ids), np.float32)
        out[order] = groups[ids // SIZE, at] - _log_sum(groups) + words[ids % SIZE, at] - _log_sum(words)
        return out

    def step(self, context: np.ndarray, ids: np.ndarray, rate: float) -> None:
        """Down the gradient of the mean negative log probability."""
        n, order, ends, at = len(ids), *_by_class(ids), np.arange(len(ids))
        context, ids = np.take(context, order, axis=1), ids[order]
        h = self.hidden(context)
        error, errors, weights = self.logits(h, ends)
        _softmax(error)
        _softmax(errors)
        error[ids // SIZE, at] -= 1
        errors[ids % SIZE, at] -= 1
        back = error.T @ self.group
        down = rate / n * (error @ h)
        self.group -= down[:, :WIDTH]
        self.group_bias -= down[:, WIDTH]
        downs = np.zeros_like(weights)
        for g, (start, end) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if start < end:
                back[start:end] += errors[:, start:end].T @ self.word[g]
                downs[g] = errors[:, start:end] @ h[start:end]
        downs *= rate / n
        self.word -= downs[:, :, :WIDTH]
        self.word_bias -= downs[:, :, WIDTH]
        back *= (1 - h[:, :WIDTH] * h[:, :WIDTH]) * (rate / n)
        self.bias -= back.sum(axis=0)
        for place, around in zip(self.embed, context, strict=True):
            sums = np.bincount(np.take(ROWS, around, axis=0).reshape(-1), back.reshape(-1), place.size)
            place -= sums.reshape(place.shape).astype(np.float32)


def _by_class(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of ids by their class, and where in it each class ends."""
    groups = (ids // SIZE).astype(np.uint16)
    return np.argsort(groups, kind="stable"), np.append(0, np.cumsum(np.bincount(groups, minlength=CLASSES)))


def _log_sum(logits: np.ndarray) -> np.ndarray:
    """Over the rows of each column."""
    top = logits.max(axis=0)
    return top + np.log(np.exp(logits - top).sum(axis=0))


def _softmax(logits: np.ndarray) -> None:
    """Over the rows of each column, in place."""
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)


def contexts(ids: np.ndarray, sizes: np.ndarray | None = None, taken: np.ndarray | None = None) -> np.ndarray:
    """The ids around each id of a text, or of texts of so many ids each, a row for each place; beyond a text's ends the edge.

    With ``taken``, a truth value for each id, only around those.
    """
    sizes = np.array([len(ids)]) if sizes is None else sizes
    at = np.arange(len(ids)) + REACH * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    wide = np.full(len(ids) + REACH * (len(sizes) + 1), EDGE, np.int32)
    wide[at] = ids
    at = at if taken is None else at[taken]
    return np.stack([wide[at + p] for p in PLACES])


def share(sizes: np.ndarray, turn: int) -> np.ndarray:
    """Which ids of texts of so many ids each a round trains on."""
    firsts = (sizes + turn) % np.clip(sizes, 1, SHARE)
    places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes + firsts, sizes)
    return (places >= 0) & (places % SHARE == 0)


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, n``: how often each word occurs in all texts, words as fingerprints; combined in each task first."""

    @tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def combined() -> pa.RecordBatch:
            words, n = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(words)
            words = words[order]
            firsts = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
            held[:] = [(words[firsts], np.add.reduceat(n[order], firsts))]
            return pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], ["word", "n"])

        for batch in batches:
            for part in slices(batch, 0):
                words, n = np.unique(hashed_texts(part.column(0).to_pylist())[0], return_counts=True)
                if len(words):
                    held.append((words, n.astype(np.int64)))
                    waiting += len(words)
                if waiting >= COUNTS:
                    out = combined()
                    waiting = out.num_rows
                    if 2 * waiting >= COUNTS:
                        yield out
                        held, waiting = [], 0
        if held:
            yield combined()

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text") -> tuple[Vocabulary, Network]:
    """Vocabulary and network of a corpus; both take in all of its texts, the network every window of them.

    Ties in frequency go to the smaller fingerprint. Null and empty texts have no words. Without any
    word the network keeps its first weights.
    """
    counts = stored(count_words(docs, text), "word-counts")
    frequent = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(WORDS).select("word").collect()]
    rare = counts.filter(~F.col("word").isin(frequent))
    shared = rare.groupBy((F.shiftrightunsigned("word", 7) % RARE).cast("int").alias("id")).agg(F.sum("n").alias("n")).collect()
    # The logarithm of a single occurrence is 0.
    several = stored(rare.filter("n > 1").select(F.col("word").alias("counted"), F.log("n").alias("log_n")), "rare-words")
    discard(counts)
    vocabulary, network = Vocabulary(frequent, several, {r["id"]: r["n"] for r in shared}), Network()
    texts, context = docs.select(F.col(text).cast("string").alias("text")), docs.sparkSession.sparkContext
    for turn in range(ROUNDS):
        given = context.broadcast(network.flat)

        @tidied
        def learn(batches: Iterator[pa.RecordBatch], given=given, turn=turn) -> Iterator[pa.RecordBatch]:
            own, learned = Network(given.value), 0
            around, ids, waiting = [], [], 0

            def descend():
                c, i = np.concatenate(around, axis=1), np.concatenate(ids)
                mixed = np.random.default_rng(learned + 1).permutation(len(i))
                for start in range(0, len(i), BATCH):
                    rows = mixed[start : start + BATCH]
                    own.step(c[:, rows], i[rows], RATE * (len(rows) / BATCH) ** 0.5 / (1 + turn))
                around.clear()
                ids.clear()
                return len(i)

            for batch in batches:
                for part in slices(batch, 0):
                    words, sizes = hashed_texts(part.column(0).to_pylist())
                    found, taken = vocabulary(words), share(sizes, turn)
                    around.append(contexts(found, sizes, taken))
                    ids.append(found[taken])
                    waiting += len(ids[-1])
                    if waiting >= 32 * BATCH:
                        learned += descend()
                        waiting = 0
            if waiting:
                learned += descend()
            if learned:
                for place, weights in enumerate(np.array_split(own.flat, 16)):
                    yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([learned], pa.int64()), pa.array([weights.tobytes()], pa.binary())], ["place", "n", "weights"])

        @tidied
        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for place, n, weights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    held = sums.setdefault(place, [0, 0.0])
                    held[0] += n
                    held[1] = held[1] + n * np.frombuffer(weights.as_buffer(), np.float32).astype(float)
            for place, (n, total) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], ["place", "n", "weights"])

        schema = "place int, n long, weights binary"
        parts = sorted(texts.mapInArrow(learn, schema).repartition("place").mapInArrow(average, schema).collect())
        if parts:
            network = Network(np.concatenate([np.frombuffer(r["weights"], np.float32) for r in parts]))
    return vocabulary, network


def each_log_likelihood(around: np.ndarray, ids: np.ndarray, network: Network) -> np.ndarray:
    """``log_probabilities`` of any number of ids."""
    parts = [network.log_probabilities(around[:, s : s + TOKENS], ids[s : s + TOKENS]) for s in range(0, len(ids), TOKENS)]
    return np.concatenate([np.zeros(0, np.float32), *parts]).astype(float)


def log_likelihoods(ids: np.ndarray, network: Network) -> float:
    return float(each_log_likelihood(contexts(ids), ids, network).sum())


def score(docs: DataFrame, vocabulary: Vocabulary, network: Network, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, log_likelihood, mean_log_likelihood`` of every whole text.

    Null and empty texts: no words, 0 and a null mean. One row for each row of ``docs``, repeated or not;
    other columns are ignored. Empty table: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, network.flat))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, with ``times`` 0, and one for each of its words that share an id."""
        known, weights = shared.value
        net = Network(weights)
        for batch in batches:
            for part in slices(batch, 2):
                all, sizes = hashed_texts(part.column(2).to_pylist())
                ids, of = known(all), np.repeat(np.arange(len(sizes)), sizes)
                sums = np.bincount(of, each_log_likelihood(contexts(ids, sizes), ids, net), len(sizes)).astype(float)  # whole numbers if there is no word
                rare = ids >= WORDS
                all, of = all[rare], of[rare]
                sums -= np.bincount(of, known.log_shared[ids[rare] - WORDS], len(sizes))
                # By text and word. Parts have few rows, so that their numbers are sorted by their digits.
                order = np.argsort(all)
                order = order[np.argsort(of[order].astype(np.uint16), kind="stable")]
                all, of = all[order], of[order]
                firsts = np.flatnonzero(np.append(True, (all[1:] != all[:-1]) | (of[1:] != of[:-1]))[: len(all)])
                times = np.diff(np.append(firsts, len(all)))
                rows = part.column(0).to_numpy()
                # Rows of texts are joined with nothing; keys of their own spread them.
                keys = rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                nothing = pa.nulls(len(firsts), pa.int64())
                columns = [
                    (pa.array(rows), pa.array(rows[of[firsts]])), (part.column(1), nothing), (pa.array(sizes, pa.int64()), nothing),
                    (pa.array(sums), pa.array(np.zeros(len(firsts)))), (pa.array(keys.view(np.int64)), pa.array(all[firsts].view(np.int64))),
                    (pa.array(np.zeros(len(rows), np.int64)), pa.array(times, pa.int64()))]
                names = ["row", "doc_id", "n_words", "log_likelihood", "word", "times"]
                for kind in range(2):
                    yield pa.RecordBatch.from_arrays([c[kind] for c in columns], names)

    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = given.mapInArrow(run, "row long, doc_id long, n_words long, log_likelihood double, word long, times long")
    if vocabulary.rare is not None:
        rare = vocabulary.rare
        rare = F.broadcast(rare) if rare.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rare
        out = out.join(rare, (F.col("word") == F.col("counted")) & (F.col("times") > 0), "left")
        out = out.withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce(F.col("times") * F.col("log_n"), F.lit(0.0)))
    out = out.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("log_likelihood").alias("log_likelihood"))
    mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    return out.select("doc_id", "n_words", "log_likelihood", mean.alias("mean_log_likelihood"))
