"""Quality by ordinal regression on graded ratings.

Cumulative links: ``P(grade > k) = sigmoid(w . x - t_k)`` with one set of weights for all grades and
thresholds in increasing order. ``x`` has the hashed words, word shapes and line shapes of a text; the
expected grade and the probability of at least some grade follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import slices, stored, tidied
from pagelens.llm.fingerprints import of_ranges

BITS = 18
#: Rated rows that are learned from, at most, of each grade.
SAMPLE = 2500
RIDGE, STEPS = 1e-4, 200

LOWER = np.array([c | 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: Letters, capitals and digits each as one sign; the other characters as they are.
SHAPE = np.array([ord("9") if 48 <= c <= 57 else ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else c for c in range(256)], np.uint8)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed columns and their values, of length one together: words, shapes of words, how words repeat."""
    data = np.frombuffer(text.encode(), np.uint8)
    full = data > 32
    starts = np.flatnonzero(full & ~np.append(False, full[:-1]))
    ends = np.flatnonzero(full & ~np.append(full[1:], False)) + 1
    if not len(starts):
        return np.array([0]), np.array([1.0])
    words = of_ranges(LOWER[data], starts, ends)
    shape = SHAPE[data]
    kept = np.append(True, shape[1:] != shape[:-1]) | ~full  # a run of one sign counts once
    place = np.cumsum(kept) - kept
    shapes = of_ranges(shape[kept], place[starts], place[ends - 1] + kept[ends - 1])
    distinct = len(np.unique(words)) / len(words)
    facts = [f"distinct {int(distinct * 10)}", f"words {int(np.log2(len(words)))}", f"length {int((ends - starts).mean())}",
             f"lines {int(np.log2(1 + (data == 10).sum()))}"]
    extra = [int.from_bytes(f.encode()[:24].ljust(24, b" "), "little") % (1 << 61) for f in facts]
    columns, counts = np.unique(np.concatenate([words, shapes ^ np.uint64(0xA5A5A5A5), np.array(extra, np.uint64)]) % np.uint64((1 << BITS) - 1) + np.uint64(1), return_counts=True)
    values = np.log1p(counts)
    return columns.astype(np.int64), values / np.sqrt((values**2).sum())


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class Model:
    """Grades are 0 to ``len(thresholds)``."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, text: str) -> np.ndarray:
        """Probabilities of more than each grade but the last."""
        columns, values = features(text)
        return _sigmoid(self.weights[columns] @ values - self.thresholds)


def train(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, most: int) -> Model:
    """Maximum likelihood by Adam; thresholds stay in order as a first one and positive steps."""
    columns = np.concatenate([c for c, _ in rows])
    values = np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(len(rows)), [len(c) for c, _ in rows])
    used, columns = np.unique(columns, return_inverse=True)
    size = len(used)
    steps = np.log(np.expm1(np.ones(most - 1)))
    p = np.concatenate([np.zeros(size), [0.0], steps])
    mean, square = np.zeros_like(p), np.zeros_like(p)
    at = np.arange(len(rows))
    for step in range(1, STEPS + 1):
        w, t = p[:size], np.cumsum(np.append(p[size], np.log1p(np.exp(p[size + 1 :]))))
        above = _sigmoid(np.bincount(row, w[columns] * values, len(rows))[:, None] - t)
        cumulative = np.hstack([np.ones((len(rows), 1)), above, np.zeros((len(rows), 1))])
        chance = np.maximum(cumulative[at, grades] - cumulative[at, grades + 1], 1e-9)
        slope = np.hstack([np.zeros((len(rows), 1)), above * (1 - above), np.zeros((len(rows), 1))])
        by_z = -(slope[at, grades] - slope[at, grades + 1]) / chance / len(rows)
        by_t = np.zeros(most + 2)
        np.add.at(by_t, grades, slope[at, grades] / chance / len(rows))
        np.add.at(by_t, grades + 1, -slope[at, grades + 1] / chance / len(rows))
        later = np.cumsum(by_t[1 : most + 1][::-1])[::-1]
        g = np.concatenate([np.bincount(columns, by_z[row] * values, size) + RIDGE * w, later[:1], later[1:] * _sigmoid(p[size + 1 :])])
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g**2
        p -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = p[:size]
    return Model(weights, np.cumsum(np.append(p[size], np.log1p(np.exp(p[size + 1 :])))))


def fit(docs: DataFrame, ratings: DataFrame, id: str = "doc_id", text: str = "text", grade: str = "quality") -> Model:
    """A model from at most ``SAMPLE`` rows of each grade (0 and up), drawn by hash.

    Null ids and grades are left out, ids without a document too; null and empty texts count as texts without words,
    long ones are read whole. Without any rated document every
    grade but the first is as likely as not.
    """
    known = ratings.select(F.col(id).cast("long").alias("no"), F.col(grade).cast("int").alias("grade")).filter("no is not null and grade >= 0")
    grades = [r["grade"] for r in known.select("grade").distinct().orderBy("grade").collect()]
    if not grades:
        return Model(np.zeros(1 << BITS, np.float32), np.zeros(1))
    order = F.xxhash64("no", F.lit("quality"))
    drawn = None
    for value in grades:
        part = known.filter(F.col("grade") == value).orderBy(order).limit(SAMPLE)
        drawn = part if drawn is None else drawn.unionAll(part)

    @tidied
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = [features(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([c.astype("<i4").tobytes() for c, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())],
                    ["grade", "columns", "values"])

    texts = docs.select(F.col(id).cast("long").alias("no"), F.col(text).cast("string").alias("text"))
    sample = stored(texts.join(F.broadcast(drawn), "no").select("grade", "text").mapInArrow(describe, "grade int, columns binary, values binary"), "quality-sample").collect()
    if not sample:
        return Model(np.zeros(1 << BITS, np.float32), np.zeros(max(1, max(grades))))
    rows = [(np.frombuffer(r["columns"], "<i4").astype(np.int64), np.frombuffer(r["values"], "<f4").astype(float)) for r in sample]
    return train(rows, np.array([r["grade"] for r in sample]), max(1, max(grades)))


def rate(docs: DataFrame, model: Model, at_least: int = 1, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, expected_grade, tail_probability``: of each whole text, the latter for ``at_least`` that grade.

    Null and empty texts are rated as texts without words. One row for each row of ``docs``, repeated or
    not; other columns are ignored. Empty table: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                tails = [shared.value.tails(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([float(t.sum()) for t in tails], pa.float64()), pa.array([float(t[at_least - 1]) for t in tails], pa.float64())],
                    ["doc_id", "expected_grade", "tail_probability"])

    given = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double")
