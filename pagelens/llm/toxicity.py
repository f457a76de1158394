"""Toxicity by a classifier whose scores don't hang on who is mentioned.

Features are the words of a text, those said again and their beginnings, each present or not. Logistic regression is
fitted in numpy with one more term: in labelled texts that mention a group, the term is swapped for
another of its kind, and the squared change of the score is penalised, so that identity terms carry
no weight of their own and neutral mentions aren't taken for insults. Of texts that mention none, some are
taken again with a term put in, and held to the score of the text with another term and of the text
without any: whatever weight chance gives such terms, the penalty takes away.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelens.llm.common import bounded_batches, slices, stored, tidied

#: Labelled rows that are learned from, at most, of each label.
SAMPLE = 8000
#: Features of a model at most, and the least log-likelihood ratio (twice) that makes one.
FEATURES, LEAST_G = 20_000, 20.0
#: Weights of the counterfactual term, of the squared and of the absolute weights.
SWAPS, RIDGE, LASSO = 10.0, 1e-6, 2e-6
#: One in how many sampled texts without an identity term is taken again with one.
INSERTED = 4
THRESHOLD = 0.7

WORD = re.compile(r"[^\W\d_]+")

#: Terms that are swapped for one another, by kind and language.
IDENTITIES = [terms.split() for terms in (
    "women men girls boys", "woman man girl boy", "female male", "muslims christians jews hindus buddhists atheists",
    "muslim christian jewish hindu buddhist atheist", "black white asian latino african arab european",
    "gay lesbian straight bisexual transgender queer", "disabled blind deaf autistic", "immigrants refugees foreigners migrants",
    "immigrant refugee foreigner migrant", "elderly young old", "americans mexicans chinese indians russians turks poles",
    "frauen männer mädchen jungen", "muslime christen juden hindus buddhisten atheisten", "schwarze weiße asiaten araber",
    "schwule lesben heteros", "behinderte blinde gehörlose", "einwanderer flüchtlinge ausländer migranten",
    "femmes hommes filles garçons", "musulmans chrétiens juifs hindous bouddhistes athées", "noirs blancs asiatiques arabes",
    "homosexuels lesbiennes hétéros", "handicapés aveugles sourds", "immigrés réfugiés étrangers",
    "mujeres hombres chicas chicos", "musulmanes cristianos judíos hindúes budistas ateos", "negros blancos asiáticos árabes",
    "homosexuales lesbianas heterosexuales", "discapacitados ciegos sordos", "inmigrantes refugiados extranjeros",
)]
KIND = {t: terms for terms in IDENTITIES for t in terms}


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def features(found: list[str]) -> set[str]:
    """Words themselves, their first four and five letters (with a star), and words said again (with a plus)."""
    out = set(found)
    if len(out) < len(found):
        out.update([w + "+" for w, n in Counter(found).items() if n > 1])
    out.update([w[:4] + "*" for w in found if len(w) > 4])
    out.update([w[:5] + "*" for w in found if len(w) > 5])
    return out


def swapped(found: list[str], seed: int) -> list[str] | None:
    """The words with every identity term replaced by another of its kind; None if there is none."""
    named = KIND.keys() & set(found)
    if not named:
        return None
    new = {}
    for term in named:
        others = [t for t in KIND[term] if t not in named] or [t for t in KIND[term] if t != term]
        new[term] = others[(seed + zlib.crc32(term.encode())) % len(others)]
    return [new.get(w, w) for w in found]


def inserted(found: list[str], seed: int) -> list[str] | None:
    """The words with an identity term put in somewhere, for one in ``INSERTED`` texts; else None."""
    draw = zlib.crc32(f"{seed} {len(found)}".encode())
    if draw % INSERTED or not found:
        return None
    terms = IDENTITIES[draw // INSERTED % len(IDENTITIES)]
    place = draw // 7 % (len(found) + 1)
    return [*found[:place], terms[draw // 11 % len(terms)], *found[place:]]


@dataclass
class Model:
    bias: float
    weights: dict[str, float]
    #: Pairs of texts that differ in an identity term and were held to the same score.
    pairs: int = 0

    def __post_init__(self):
        # Nearly all words have no feature; their first letters tell.
        self.gate = {f.rstrip("*+")[:4] for f in self.weights}

    def score(self, text: str) -> float:
        near = [w for w in words(text) if w[:4] in self.gate]
        z = self.bias + sum(self.weights.get(f, 0.0) for f in features(near))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


class Rows:
    """Sparse rows of ones."""

    def __init__(self, rows: list[list[int]]):
        self.n = len(rows)
        self.columns = np.array([i for r in rows for i in r], np.int64)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.columns], self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.columns, g[self.row], size)


def train(rows: list[list[int]], labels: np.ndarray, swaps: list[list[int] | None], size: int, steps: int = 600) -> tuple[float, np.ndarray]:
    """Weights by Adam on the whole sample; each label has half of the weight."""
    x = Rows(rows)
    pairs = [i for i, s in enumerate(swaps) if s is not None]
    a, b = Rows([rows[i] for i in pairs]), Rows([swaps[i] for i in pairs])
    y = labels.astype(float)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w = np.zeros(size + 1)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x.times(w[:-1]) + w[-1], -500, 500)))
        error = weight * (p - y)
        gradient = np.append(x.back(error, size) + RIDGE * w[:-1], error.sum())
        if pairs:
            change = 2 * SWAPS * (a.times(w[:-1]) - b.times(w[:-1])) / len(pairs)
            gradient[:-1] += a.back(change, size) - b.back(change, size)
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        rate = 0.1 * (1 if step < steps // 2 else 0.3)
        w -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - rate * LASSO, 0)
    return float(w[-1]), w[:-1]


def _association(a: F.Column, c: F.Column, toxic: int, clean: int) -> F.Column:
    """Twice the log-likelihood ratio of a feature in ``a`` of the toxic and ``c`` of the clean texts."""
    share = (a + c) / (toxic + clean)

    def part(seen: F.Column, expected: F.Column) -> F.Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    return 2 * (part(a, share * toxic) + part(c, share * clean) + part(toxic - a, (1 - share) * toxic) + part(clean - c, (1 - share) * clean))


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from at most ``SAMPLE`` rows of each label, drawn by hash.

    ``labels`` must hold only rows to learn from. Rows with a null id or label are left out, ids
    without a document too. With one label alone, or none, the model has only a bias.
    """
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col(id).cast("long").alias("no"), (F.col(label) == 1).cast("int").alias("y")).filter("no is not null and y is not null")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    toxic_share = (counts.get(1, 0) + 0.5) / (total + 1)
    order = F.xxhash64("no", F.lit("toxicity"))
    drawn = F.broadcast(known.filter("y = 1").orderBy(order).limit(SAMPLE).unionAll(known.filter("y = 0").orderBy(order).limit(SAMPLE)))

    @tidied
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                rows = []
                for no, y, text in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    found = words(text or "")
                    other = swapped(found, no)
                    rows.append((y, found, other))
                    named = inserted(found, no) if other is None else None
                    if named:
                        rows += [(y, named, swapped(named, no)), (y, named, found)]
                labels, found, other = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(labels, pa.int32()), pa.array([list(features(w)) for w in found], pa.list_(pa.string())),
                     pa.array([None if w is None else list(features(w)) for w in other], pa.list_(pa.string()))],
                    ["y", "features", "swapped"])

    texts = docs.select(F.col(id).cast("long").alias("no"), F.col(text).cast("string").alias("text"))
    sample = stored(texts.join(drawn, "no").select("no", "y", "text").mapInArrow(describe, "y int, features array<string>, swapped array<string>"), "toxic-sample")
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model(float(np.log(toxic_share / (1 - toxic_share))), {})
    seen = sample.select("y", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("c")).filter("a + c >= 5")
    strong = seen.withColumn("g", _association(F.col("a"), F.col("c"), toxic, clean)).filter(F.col("g") >= LEAST_G)
    strong = strong.orderBy(F.col("g").desc(), "feature").limit(FEATURES)
    names = [r["feature"] for r in strong.select("feature").collect()]
    names += sorted(features(list(KIND)).difference(names))
    place = {f: i for i, f in enumerate(names)}

    @tidied
    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ones = [pa.array([None if r is None else sorted(place[f] for f in r if f in place) for r in batch.column(i).to_pylist()], pa.list_(pa.int32())) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *ones], ["y", "ones", "others"])

    rows = sample.mapInArrow(indexed, "y int, ones array<int>, others array<int>").collect()
    bias, weights = train([r["ones"] for r in rows], np.array([r["y"] for r in rows]), [r["others"] for r in rows], len(names))
    return Model(bias, {f: float(w) for f, w in zip(names, weights, strict=True) if w}, sum(r["others"] is not None for r in rows))


def _scores(model: Model, texts: pa.Array) -> list[float]:
    return [model.score(t or "") for t in texts.to_pylist()]


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score``: probability that each whole text is toxic.

    Null and empty texts get the model's bias. One row for each row of ``docs``, repeated or not;
    other columns are ignored. Empty table: no rows.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_scores(model, part.column(1)), pa.float64())], ["doc_id", "score"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` scored below ``threshold``, with all their columns, whatever their names.

    Null and empty texts get the model's bias as score; ids play no part. Repeated rows are kept or go alike, long
    texts are scored whole. Empty table: no rows.
    """
    place = docs.columns.index(text)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, place):
                yield part.filter(pa.array([s < threshold for s in _scores(model, part.column(place))], pa.bool_()))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def held_out(id) -> F.Column:
    """Whether a document's label is kept for measuring."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def digest(scores: DataFrame) -> DataFrame:
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
