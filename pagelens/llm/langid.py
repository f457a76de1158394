"""Languages by interpolated Kneser-Ney models of characters, one for each language.

A text is its letters in lower case, with a blank for whatever lies between words. N-grams of letters are numbers,
kept for all languages together in arrays sorted by a hash of them, with the interpolated log-probability of the
last letter in each language. A text has the language with the lowest cross-entropy per letter; how sure that
is, and from where on a text is like none of them, is measured on labelled texts that the counts leave out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import bounded_batches, discard, slices, stored, tidied

ORDER = 5
#: Labelled texts that are learned from, about, of each language, and one in how many of them is for calibration only, if there are not few.
SAMPLE, CALIBRATION, FEW = 4000, 5, 50
#: Letters of the alphabet, as a power of two; the rarest beyond are one letter. N-grams of a model at most, most frequent first.
LETTER_BITS, NGRAMS = 12, 300_000
#: The share of texts in their own language that may be rejected.
REJECTED = 0.001
#: Characters that are looked at together; longer texts are read in parts, the log-likelihoods added.
PART = 1 << 20
#: No language: no letters.
NONE = "und"

BLANK, RARE = 0, 1
#: Odd, so that multiplying by it modulo 2**64 is one to one.
HASH = np.uint64(0x9E3779B97F4A7C15)
TEMPERATURES = 2.0 ** np.arange(-12, 1)


def blocks(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts of together some ``PART`` characters, with their places; longer texts in parts, each read like a text."""
    owners, parts, size = [], [], 0
    for i, text in enumerate(texts):
        for start in range(0, len(text), PART):
            owners.append(i)
            parts.append(text[start : start + PART])
            size += len(parts[-1])
            if size >= PART:
                yield owners, parts
                owners, parts, size = [], [], 0
    if parts:
        yield owners, parts


class Table:
    """Numbers of n-grams, sorted by their hashes; the first bits of a hash tell where to begin looking."""

    def __init__(self, keys: np.ndarray):
        hashes = keys.astype(np.uint64) * HASH
        self.order = np.argsort(hashes, kind="stable")
        hashes = hashes[self.order]
        self.shift = np.uint64(64 - max(1, int(np.ceil(np.log2(2 * len(keys) + 2)))))
        begins = np.bincount((hashes >> self.shift).astype(np.int64), minlength=1 << int(np.uint64(64) - self.shift))
        self.depth = int(begins.max(initial=0))
        self.begins = np.append(0, np.cumsum(begins)).astype(np.int32)
        self.hashes = np.append(hashes, np.uint64(0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each number in sorted order, or -1."""
        wanted = keys.astype(np.uint64) * HASH
        bucket = (wanted >> self.shift).astype(np.int64)
        row = self.begins[bucket]
        last = len(self.hashes) - 1
        for _ in range(self.depth - 1):
            row = np.minimum(row + (self.hashes[row] < wanted), last)
        return np.where((row < last) & (self.hashes[row] == wanted), row, -1)


def encoded(texts: list[str], symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all texts one after the other, which of them count, and the text each belongs to.

    Every text comes after as many blanks as a context has letters, which don't count.
    """
    low = [t.lower() for t in texts]
    pad = " " * (ORDER - 1)
    codes = np.frombuffer((pad + pad.join(low)).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    owner = np.repeat(np.arange(len(low)), sizes + ORDER - 1)
    own = np.ones(len(codes), bool)
    starts = np.cumsum(sizes + ORDER - 1) - sizes
    for i in range(1, ORDER):
        own[starts - i] = False
    letters = symbols[codes]
    kept = ~own | (letters != BLANK)
    kept[1:] |= letters[:-1] != BLANK
    return letters[kept].astype(np.int64), own[kept], owner[kept]


def ngrams(letters: np.ndarray) -> list[np.ndarray]:
    """For each order from 1 the numbers of the n-grams that end at each letter."""
    out = [letters]
    for _ in range(1, ORDER):
        longer = letters.copy()
        longer[1:] |= out[-1][:-1] << LETTER_BITS
        out.append(longer)
    return out


@cache
def is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def symbol_table(alphabet: list[int]) -> np.ndarray:
    """The number of every code point: 0 for blanks, 1 for letters outside the alphabet."""
    out = np.where(is_letter(), RARE, BLANK).astype(np.uint16)
    out[alphabet] = np.arange(2, len(alphabet) + 2)
    return out


@dataclass
class Model:
    """``tables[n]`` has the n-grams of ``n + 1`` letters; for each and each language the log-probability of its last letter and
    the log-weight of the shorter context after it. ``single`` has the log-probabilities of letters alone, ``pooled`` those of all languages taken together."""

    languages: list[str]
    alphabet: list[int]
    tables: list[Table] = field(default_factory=list)
    chances: list[np.ndarray] = field(default_factory=list)
    backoffs: list[np.ndarray] = field(default_factory=list)
    single: np.ndarray | None = None
    pooled: np.ndarray | None = None
    temperature: float = 1.0
    limit: float = float("inf")

    def log_likelihoods(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text how many letters and blanks count, whether it has letters, its log-likelihood in each language, and pooled."""
        out = [np.zeros(len(texts), np.int64), np.zeros(len(texts), bool), np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))]
        for owners, parts in blocks(texts):
            for whole, part in zip(out, self._parts(parts), strict=True):
                np.add.at(whole, owners, part)
        return tuple(out)

    def _parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        letters, own, owner = encoded(texts, _symbols(tuple(self.alphabet)))
        grams = ngrams(letters)
        total = np.zeros((len(letters), len(self.languages)), np.float32)
        left = np.flatnonzero(own)
        for n in range(ORDER - 1, 0, -1):
            row = self.tables[n].find(grams[n][left])
            hit = row >= 0
            total[left[hit]] += self.chances[n][row[hit]]
            left = left[~hit]
            context = self.tables[n - 1].find(grams[n - 1][left - 1])
            known = context >= 0
            total[left[known]] += self.backoffs[n - 1][context[known]]
        total[left] += self.single[letters[left]]
        count = len(texts)
        sums = np.stack([np.bincount(owner, total[:, i], count) for i in range(len(self.languages))], axis=1)
        return (np.bincount(owner[own], minlength=count), np.bincount(owner, letters != BLANK, count) > 0, sums,
                np.bincount(owner, np.where(own, self.pooled[letters], 0), count))

    def identify(self, texts: list[str]) -> list[tuple]:
        """For each text its language, the probability of it, its cross-entropy per letter and whether it is like no language."""
        if not self.languages:
            return [(NONE, 0.0, None, None)] * len(texts)
        sizes, lettered, sums, pooled = self.log_likelihoods(texts)
        best, chance = sums.argmax(axis=1), posteriors(sums, self.temperature)
        out = []
        for i, size in enumerate(sizes.tolist()):
            if not lettered[i]:
                out.append((NONE, 0.0, None, None))
                continue
            gain = (pooled[i] - sums[i, best[i]]) / size
            out.append((self.languages[best[i]], float(chance[i, best[i]]), float(-sums[i, best[i]] / size), bool(gain > self.limit)))
        return out


@cache
def _symbols(alphabet: tuple[int, ...]) -> np.ndarray:
    return symbol_table(list(alphabet))


def posteriors(sums: np.ndarray, temperature: float) -> np.ndarray:
    z = np.exp((sums - sums.max(axis=1, keepdims=True)) * temperature)
    return z / z.sum(axis=1, keepdims=True)


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(place, values, len(distinct))


def _discount(counts: np.ndarray) -> float:
    """Absolute discount by the numbers of n-grams seen once and twice."""
    once, twice = (counts == 1).sum(), (counts == 2).sum()
    return float(once / (once + 2 * twice)) if once and twice else 0.5


def kneser_ney(languages: list[str], alphabet: list[int], counted: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """A model from the n-grams of the highest order and their counts in each language.

    Shorter n-grams count by how many letters come before them. An order's estimate is discounted, and the
    discounted share goes to the next shorter context; letters alone share theirs equally.
    """
    mask = [np.int64((1 << LETTER_BITS * n) - 1) for n in range(ORDER + 1)]
    levels = []  # of each language: of each order, n-grams and counts
    for keys, counts in counted:
        own = {ORDER: (keys.astype(np.int64), counts.astype(float))}
        for n in range(ORDER - 1, 0, -1):
            longer = own[n + 1][0]
            own[n] = _grouped(longer & mask[n], np.ones(len(longer)))
        levels.append(own)
    model = Model(languages, alphabet, tables=[None], chances=[None], backoffs=[])
    width, size = len(languages), len(alphabet) + 2
    single = np.zeros((size, width))
    for i, own in enumerate(levels):
        keys, counts = own[1]
        taken, total = _discount(counts), counts.sum()
        seen = np.zeros(size)
        seen[keys] = counts
        single[:, i] = (np.maximum(seen - taken, 0) + taken * len(keys) / size) / total
    model.single = np.log(single).astype(np.float32)
    weights = np.array([own[1][1].sum() for own in levels])
    model.pooled = np.log(single @ (weights / weights.sum()))

    def contexts(n: int) -> np.ndarray:
        """N-grams of ``n`` letters that longer ones begin with."""
        return np.concatenate([own[n + 1][0] >> LETTER_BITS for own in levels])

    def laid_out(n: int, chances: np.ndarray | None, keys: np.ndarray) -> None:
        table = Table(keys)
        backoff = np.zeros((len(keys), width))
        if n < ORDER:
            for i, own in enumerate(levels):
                after, counts = own[n + 1]
                parents, total = _grouped(after >> LETTER_BITS, counts)
                _, kinds = _grouped(after >> LETTER_BITS, np.ones(len(after)))
                backoff[np.searchsorted(keys, parents), i] = np.log(_discount(counts) * kinds / total)
        if n > 1:
            model.tables.append(table)
            model.chances.append(np.log(chances)[table.order].astype(np.float32))
        else:
            model.tables[0] = table
        model.backoffs.append(backoff[table.order].astype(np.float32))

    below, below_keys = single, np.arange(size, dtype=np.int64)
    laid_out(1, None, below_keys)
    for n in range(2, ORDER + 1):
        found = [own[n][0] for own in levels]
        keys = np.unique(np.concatenate([*found, contexts(n)] if n < ORDER else found))
        # What is left of an n-gram without its first letter is in the table below, since that has the beginnings of all n-grams, too.
        shorter = below[np.searchsorted(below_keys, keys & mask[n - 1])]
        chances = shorter.copy()
        for i, own in enumerate(levels):
            grams, counts = own[n]
            taken = _discount(counts)
            parents, total = _grouped(grams >> LETTER_BITS, counts)
            _, kinds = _grouped(grams >> LETTER_BITS, np.ones(len(grams)))
            at = np.minimum(np.searchsorted(parents, keys >> LETTER_BITS), len(parents) - 1)
            known = parents[at] == keys >> LETTER_BITS
            place = np.minimum(np.searchsorted(grams, keys), len(grams) - 1)
            own_count = np.where(grams[place] == keys, counts[place], 0)
            estimate = (np.maximum(own_count - taken, 0) + taken * kinds[at] * shorter[:, i]) / total[at]
            chances[:, i] = np.where(known, estimate, shorter[:, i])
        laid_out(n, chances, keys)
        below, below_keys = chances, keys
    return model


def sampled(docs: DataFrame, id: str, text: str, lang: str) -> DataFrame:
    """``lang, text, measures``, written: some ``SAMPLE`` texts of each language, drawn by hash, repeated ones once."""
    draw = F.xxhash64(F.col(id), F.col(text)).cast("double") / F.lit(2.0**64) + F.lit(0.5)
    known = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), draw.alias("draw")).filter("lang is not null and text is not null")
    sizes = F.broadcast(known.groupBy("lang").agg(F.count("*").alias("n")))  # a row for each language
    drawn = known.join(sizes, "lang").filter(F.col("draw") * F.col("n") < SAMPLE)
    measures = (F.col("n") >= FEW) & (F.pmod(F.xxhash64("text", F.lit("calibration")), F.lit(CALIBRATION)) == 0)
    return stored(drawn.select("lang", "text", measures.alias("measures")).dropDuplicates(["lang", "text"]), "languages")


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model of the languages in ``docs``, which must hold only rows to learn from.

    Some ``SAMPLE`` texts of each language are drawn, long ones taken whole. Rows without a language or a text are
    left out. With no row left the model knows no language.
    """
    bounded_batches(docs.sparkSession)
    sample = sampled(docs, id, text, lang)

    @tidied
    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                codes = np.frombuffer("".join(part.column(0).to_pylist()).lower().encode("utf-32-le"), np.uint32)
                found, n = np.unique(codes[is_letter()[codes]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(n.astype(np.int64))], ["letter", "n"])

    # At most all letters of Unicode.
    most = sample.select("text").mapInArrow(letters, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n"))
    alphabet = [r["letter"] for r in most.orderBy(F.desc("n"), "letter").limit((1 << LETTER_BITS) - 2).collect()]
    learned = sample.filter("not measures") if sample.filter("not measures").limit(1).count() else sample

    @tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = symbol_table(alphabet)
        for batch in batches:
            for part in slices(batch, 1):
                of = np.array(part.column(0).to_pylist(), dtype=object)
                texts = part.column(1).to_pylist()
                for language, block in ((g, p) for g in sorted(set(of)) for _, p in blocks([t for t, o in zip(texts, of, strict=True) if o == g])):
                    found, own, _ = encoded(block, symbols)
                    keys, n = np.unique(ngrams(found)[-1][own], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([language] * len(keys), pa.string()), pa.array(keys), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    grams = learned.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = stored(grams, "grams")
    least, many = 1, 0
    for r in grams.groupBy("n").agg(F.count("*").alias("grams")).orderBy(F.desc("n")).collect():
        many += r["grams"]
        least = r["n"]
        if many > NGRAMS:
            least += 1
            break
    rows = grams.filter(F.col("n") >= least).toPandas()
    discard(grams)
    languages = sorted(rows["lang"].unique())
    if not languages:
        discard(sample)
        return Model([], [])
    counted = []
    for language in languages:
        own = rows[rows["lang"] == language].sort_values("gram")
        counted.append((own["gram"].to_numpy(np.int64), own["n"].to_numpy(float)))
    model = kneser_ney(languages, alphabet, counted)
    calibrate(model, sample.filter("measures") if sample.filter("measures").limit(1).count() else sample)
    discard(sample)
    return model


def calibrate(model: Model, texts: DataFrame) -> None:
    """Sets the temperature that makes the labels likeliest, and the limit that ``REJECTED`` of texts in their own language pass."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    @tidied
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sizes, lettered, sums, pooled = shared.value.log_likelihoods(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.where(lettered, sizes, 0)), pa.array(list(sums), pa.list_(pa.float64())), pa.array(pooled)], ["lang", "n", "sums", "pooled"])

    # About SAMPLE / CALIBRATION rows of each language.
    rows = [r for r in texts.select("lang", "text").mapInArrow(measure, "lang string, n long, sums array<double>, pooled double").collect() if r["n"] and r["lang"] in model.languages]
    if not rows:
        return
    sums, truth = np.array([r["sums"] for r in rows]), np.array([model.languages.index(r["lang"]) for r in rows])
    at = np.arange(len(rows))
    losses = [-np.log(np.maximum(posteriors(sums, t)[at, truth], 1e-12)).mean() for t in TEMPERATURES]
    model.temperature = float(TEMPERATURES[int(np.argmin(losses))])
    gains = (np.array([r["pooled"] for r in rows]) - sums[at, truth]) / np.array([r["n"] for r in rows])
    model.limit = float(np.quantile(gains, 1 - REJECTED))


def identify(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, cross_entropy, rejected``: the language of each whole text.

    ``score`` is the calibrated probability of ``lang_pred`` among the learned languages. ``rejected`` says that the
    text gains less over letters alone than nearly all texts in their own language do: it is likely in none of them.

    Null, empty and other texts without letters have the language ``und``, score 0 and no cross-entropy; so has
    every text if no language was learned. Equally likely languages: the first in order. One row for each row of
    ``docs``, repeated or not, null ids too; other columns are ignored. Empty table: no rows.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = shared.value.identify([t or "" for t in part.column(1).to_pylist()])
                lang, score, entropy, rejected = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(rejected, pa.bool_())],
                    ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    given = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")


def held_out(id: Column) -> Column:
    """Whether a document's language is kept for measuring."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
