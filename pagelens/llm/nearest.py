"""Nearest neighbours by multi-index hashing.

Fit: PCA directions and learned rotations (iterative quantisation) of a bounded sample turn a vector
into a binary code. Index: codes are cut into substrings of a byte, and each slab of vectors keeps,
for every substring, its rows sorted by the value of that byte. Search: a code within Hamming radius
``r`` of the query has a substring within ``r // m`` of the query's (one of ``m``), so looking up all
values that close retrieves every code within the radius; the original vectors rank what was found.
The radius is measured: exact neighbours of some queries tell how far the codes of neighbours lie.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.common import scratch, stored, tidied
from pagelens.operators.spread import top_n

#: Vectors that the rotations are learned from, at most.
SAMPLE = 20_000
#: Rotations; each gives one bit per dimension.
ROTATIONS = 4
#: Vectors of a slab, queries of a block (what a task and the driver hold at once).
SLAB, BLOCK = 8192, 4096
#: Queries whose exact neighbours set the radius, and the share of those neighbours within it.
PROBES, WITHIN = 64, 0.985

POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
FOUND = "query_no long, vec_id long, score double, hamming int"


class Codes:
    """Rotated binary codes learned from a sample."""

    def __init__(self, sample: np.ndarray, seed: int = 7):
        self.mean = sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])
        centred = sample - self.mean
        dims = sample.shape[1]
        cover = centred.T @ centred / max(1, len(sample)) + 1e-12 * np.eye(dims)
        axes = np.linalg.eigh(cover)[1][:, ::-1]
        projected = centred @ axes
        random, turns = np.random.default_rng(seed), []
        for _ in range(ROTATIONS):
            turn = np.linalg.qr(random.normal(size=(dims, dims)))[0]
            for _ in range(25):
                u, _, v = np.linalg.svd(np.where(projected @ turn >= 0, 1.0, -1.0).T @ projected)
                turn = (u @ v).T
            turns.append(axes @ turn)
        self.turn = np.hstack(turns)

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as bytes: a row per vector, a column per substring."""
        return np.packbits((vectors - self.mean) @ self.turn >= 0, axis=1)


class Slab:
    """Vectors with the sorted substrings of their codes: rows by value, and where a value starts."""

    def __init__(self, members, ends, vectors, codes, order, starts):
        self.members, self.ends, self.vectors, self.codes = members, ends, vectors, codes
        self.order, self.starts = order, starts

    @classmethod
    def of(cls, members: list, vectors: np.ndarray, codes: np.ndarray) -> Slab:
        order = np.stack([np.argsort(c, kind="stable") for c in codes.T]).astype(np.int32)
        starts = np.stack([np.searchsorted(c[o], np.arange(257)) for c, o in zip(codes.T, order, strict=True)])
        return cls(np.concatenate(members).astype(np.int64), np.cumsum([len(m) for m in members]), vectors, codes, order, starts)

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **vars(self))
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Slab:
        with np.load(io.BytesIO(data)) as arrays:
            return cls(**arrays)

    def ids(self, row: int) -> np.ndarray:
        return self.members[self.ends[row - 1] if row else 0 : self.ends[row]]

    def within(self, code: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All rows whose code is within ``radius``, with their distance.

        Pigeonhole: with ``radius = m * a + b``, one of the first ``b + 1`` substrings differs in at
        most ``a`` bits, or one of the others in at most ``a - 1``.
        """
        m = self.codes.shape[1]
        a, b = divmod(radius, m)
        hit = np.zeros(len(self.codes), bool)
        for s in range(m):
            most = a if s <= b else a - 1
            if most < 0:
                continue
            values = np.flatnonzero(POPCOUNT[np.arange(256) ^ int(code[s])] <= most)
            first, size = self.starts[s][values], self.starts[s][values + 1] - self.starts[s][values]
            ends = np.cumsum(size)
            if len(ends) and ends[-1]:
                hit[self.order[s][np.arange(ends[-1]) + np.repeat(first - (ends - size), size)]] = True
        rows = np.flatnonzero(hit)
        distance = POPCOUNT[self.codes[rows] ^ code].sum(axis=1, dtype=np.int64)
        near = distance <= radius
        return rows[near], distance[near]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column.to_pylist()]) if len(column) else np.zeros((0, 1))


def _usable(vector):
    """Components all finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def classes(vectors: DataFrame, id: str, vector: str, keep: int) -> DataFrame:
    """``no, vector, members``: distinct vectors with their ``keep`` smallest ids.

    A query needs no more of a class, so copies of one vector, however many, are one row from here
    on. Smallest ids are chosen in salted slices first.
    """
    valid = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).filter(
        F.col("id").isNotNull() & _usable(F.col("vector")))
    ranked = top_n(valid, ["vector"], [F.col("id")], keep, "id", "rank")
    return ranked.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("members")).select(
        F.xxhash64("vector").alias("no"), "vector", "members")


def build_index(distinct: DataFrame, codes: Codes) -> DataFrame:
    """One row per slab: vectors, members, codes and sorted substrings, packed."""

    @tidied
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLAB):
                part = batch.slice(start, SLAB)
                vectors = _matrix(part.column(0))
                slab = Slab.of(part.column(1).to_pylist(), vectors, codes(vectors))
                yield pa.RecordBatch.from_arrays([pa.array([slab.packed()], pa.binary())], ["slab"])

    return distinct.select("vector", "members").mapInArrow(pack, "slab binary")


def _ranked(slab: Slab, rows: np.ndarray, hamming: np.ndarray, no: int, query: np.ndarray, k: int):
    """The ``k`` nearest members of the rows by exact distance; ties to smaller ids."""
    score = np.sqrt(((slab.vectors[rows] - query) ** 2).sum(axis=1))
    bound = np.partition(score, k - 1)[k - 1] if len(score) > k else np.inf
    near = [(s, i, h) for r, s, h in zip(rows[score <= bound], score[score <= bound], hamming[score <= bound], strict=True) for i in slab.ids(r)]
    return [(no, int(i), float(s), int(h)) for s, i, h in sorted(near)[:k]]


def _search(index: DataFrame, queries: list, codes: Codes, k: int, radius: int | None) -> DataFrame:
    """Rows of each slab for a block of queries; without ``radius`` all rows, for measuring."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    @tidied
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0):
                slab, out = Slab.unpacked(packed.as_py()), []
                for no, vector, reach in shared.value:
                    query = np.asarray(vector, float)
                    code = codes(query[None])[0]
                    if radius is None:
                        rows = np.arange(len(slab.codes))
                        hamming = POPCOUNT[slab.codes ^ code].sum(axis=1, dtype=np.int64)
                    else:
                        rows, hamming = slab.within(code, reach)
                    if len(rows):
                        out += _ranked(slab, rows, hamming, no, query, k)
                columns = list(zip(*out, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int32()), strict=True)],
                    ["query_no", "vec_id", "score", "hamming"])

    return index.mapInArrow(probe, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    return top_n(found, ["query_no"], [F.col("score"), F.col("vec_id")], k, "vec_id")


def fit(distinct: DataFrame, dims: int) -> Codes:
    """Codes learned from at most ``SAMPLE`` vectors, drawn by hash."""
    sample = distinct.orderBy(F.xxhash64("no")).limit(SAMPLE).select("vector").toPandas()["vector"]
    return Codes(np.stack([np.asarray(v) for v in sample]) if len(sample) else np.zeros((0, dims)))


def nearest(spark: SparkSession, vectors: DataFrame, is_query, k: int = 10, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest other rows of each row for which ``is_query`` (a column) holds.

    Returns ``query_id, rank, vec_id, score``: Euclidean distance of the original vectors in double
    precision, nearest first, ties to the smaller id; all candidates if there are fewer than ``k``.

    Vectors that are null, empty, zero, hold a null or non-finite component or have another length
    than most take no part, neither do null ids. Of rows with one id and one vector one counts. Of a
    repeated id with several vectors each is a candidate. A query is never its own candidate. Empty
    table, or no query that takes part: no rows. Queries are searched in blocks of ``BLOCK``, each written before the next one.
    """
    usable = vectors.select(F.col(id).alias("id"), F.col(vector).alias("vector"), is_query.alias("asks")).filter(
        _usable(F.col("vector")) & F.col("id").isNotNull())
    sizes = usable.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], empty)
    dims = sizes["dims"]
    usable = usable.filter(F.size("vector") == dims).dropDuplicates(["id", "vector"])
    distinct = stored(classes(usable, "id", "vector", k + 1), "vectors")
    codes = fit(distinct, dims)
    index = stored(build_index(distinct, codes), "slabs")
    asking = stored(
        usable.filter("asks").select(F.col("id").cast("long").alias("query_id"), F.xxhash64(F.col("vector").cast("array<double>")).alias("query_no"),
                                     F.col("vector").cast("array<double>").alias("vector")), "queries")
    # Queries with the same vector are searched once.
    texts = stored(asking.groupBy("query_no", "vector").agg(F.lit(1).alias("one")).select("query_no", "vector"), "query-vectors")
    if not texts.limit(1).count():
        return spark.createDataFrame([], empty)
    blocks = max(1, -(-texts.count() // BLOCK))
    radius = _radius(index, texts, codes, k, dims)
    path = scratch(spark, "found")
    for block in range(blocks):
        held = texts.filter(F.pmod(F.xxhash64("query_no"), F.lit(blocks)) == block).collect()
        for start in range(0, len(held), BLOCK):
            wanted = [(r["query_no"], r["vector"], radius) for r in held[start : start + BLOCK]]
            while wanted:
                got = stored(_best(_search(index, wanted, codes, k + 1, radius), k + 1), "block")
                have = {r["query_no"]: r["n"] for r in got.groupBy("query_no").agg(F.count("*").alias("n")).collect()}
                # Codes within the radius are too few: those queries go on with a larger one.
                short = [w for w in wanted if have.get(w[0], 0) <= k and w[2] < dims * ROTATIONS]
                again = {w[0] for w in short}
                kept = got.filter(~F.col("query_no").isin(list(again))) if again else got
                kept.write.mode("append").parquet(path)
                wanted = [(no, vector, min(dims * ROTATIONS, reach + max(8, reach // 4))) for no, vector, reach in short]
    found = spark.read.schema("query_no long, vec_id long, score double, hamming int, rank int").parquet(path)
    others = asking.select("query_id", "query_no").join(found.drop("rank"), "query_no").filter("vec_id != query_id")
    return top_n(others, ["query_id"], [F.col("score"), F.col("vec_id")], k, "vec_id").select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _radius(index: DataFrame, queries: DataFrame, codes: Codes, k: int, dims: int) -> int:
    """Radius that holds the share ``WITHIN`` of the exact neighbours of some queries."""
    probes = [(r["query_no"], r["vector"], 0) for r in queries.orderBy(F.xxhash64("query_no", F.lit(1))).limit(PROBES).collect()]
    exact = _best(_search(index, probes, codes, k + 1, None), k + 1)
    far = exact.filter("score > 0").agg(F.expr(f"percentile(hamming, {WITHIN})")).first()[0]
    return int(np.ceil(far)) if far is not None else 0
