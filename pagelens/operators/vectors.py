"""Vector work on Arrow batches: embedding texts, and exact nearest neighbours.

Neighbours are found on a grid: library vectors and queries are cut into parts, and each cell compares
one part of either in one matrix product. Only a cell's best rows per query leave it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions.text import collapse
from pagelens.model import EMBEDDED, FAILED, PENDING, SKIPPED
from pagelens.operators.ranking import TIE_DIGITS

#: Vectors on either side of a cell, give or take the unevenness of a hash: each travels once for every such part of the
#: other side. Within a cell, so many queries and vectors are multiplied at once.
BLOCK_ROWS, ASKED, TILE = 16_384, 256, 2_048
DIMENSIONS = 384
DEFAULT_MODEL = "hashing-384"

Embedder = Callable[[list[str]], list[np.ndarray | None]]


def hashing_embedder(texts: list[str]) -> list[np.ndarray | None]:
    """Unit vectors of hashed token counts: deterministic, needs no model file."""
    out = []
    for text in texts:
        vector = np.zeros(DIMENSIONS)
        for token in re.findall("[a-z0-9]{2,}", text.lower()):
            code = zlib.crc32(token.encode())
            vector[code % DIMENSIONS] += 1.0 if code & 0x80000000 else -1.0
        norm = np.linalg.norm(vector)
        out.append(vector / norm if norm else None)
    return out


def _vectors(make_embedder: Callable[[], Embedder]):
    """Vectors of a column of texts; null where the embedder cannot handle one."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = make_embedder()
        for batch in batches:
            texts = batch.tolist()
            try:
                made = embedder(texts)
            except Exception:  # one bad text fails a batch: find it by going one at a time
                made = []
                for text in texts:
                    try:
                        made.append(embedder([text])[0])
                    except Exception:
                        made.append(None)
            yield pd.Series([None if v is None else np.asarray(v, dtype="float32") for v in made])

    return vectors


def embed_queries(
    queries: DataFrame, make_embedder: Callable[[], Embedder] = lambda: hashing_embedder, text: str = "text"
) -> DataFrame:
    """``queries`` with the ``vector`` of each text, for searches; null for null and blank texts."""
    source = collapse(F.coalesce(F.col(text), F.lit("")))
    made = queries.withColumn("vector", _vectors(make_embedder)(source))
    return made.withColumn("vector", F.when(source != "", F.col("vector")))


def embed_chunks(
    chunks: DataFrame, as_of, make_embedder: Callable[[], Embedder] = lambda: hashing_embedder,
    model: str = DEFAULT_MODEL, max_chars: int | None = None,
) -> DataFrame:
    """Fill in vectors of pending chunks; other chunks pass through untouched.

    ``make_embedder`` is called once per task; ``max_chars`` is for models that read no further. Blank chunks are skipped; a text the embedder
    cannot handle is marked failed and does not stop the others.
    """

    source = collapse(F.col("text"))
    if max_chars is not None:
        source = F.substring(source, 1, max_chars)
    waiting = chunks.filter(F.col("embed_state") == PENDING).withColumn("_source", source)
    done = waiting.withColumn("embedding", _vectors(make_embedder)("_source"))
    state = (
        F.when(F.col("_source") == "", SKIPPED)
        .when(F.col("embedding").isNull(), FAILED)
        .otherwise(EMBEDDED)
    )
    done = (
        done.withColumn("embed_state", state)
        .withColumn("embed_model", F.when(F.col("embed_state") == EMBEDDED, F.lit(model)))
        .withColumn("embed_updated_at", as_of)
    )
    rest = chunks.filter(F.col("embed_state") != PENDING)
    return rest.unionByName(done.select(chunks.columns))


def embed_coverage(chunks: DataFrame) -> DataFrame:
    """Chunks per state and model."""
    return chunks.groupBy("embed_state", "embed_model").agg(F.count("*").alias("chunks"))


def unit_rows(vectors: list) -> np.ndarray:
    """Rows scaled to length one; rows of zeros stay zeros."""
    matrix = np.array([np.asarray(v, dtype="float64") for v in vectors])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def cosines(vectors: pd.Series, queries: np.ndarray) -> np.ndarray:
    """Rows by queries; 0 where a vector is missing or has another length."""
    usable = np.array([v is not None and len(v) == queries.shape[1] for v in vectors], dtype=bool)
    out = np.zeros((len(vectors), len(queries)))
    if usable.any():
        out[usable] = unit_rows(vectors[usable].tolist()) @ queries.T
    return out


def best_rows(scores: np.ndarray, ties: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best finite scores; equal scores in order of ``ties``."""
    finite = np.flatnonzero(np.isfinite(scores))
    if len(finite) <= k:
        return finite
    limit = np.partition(scores[finite], len(finite) - k)[len(finite) - k]
    above = finite[scores[finite] > limit]
    level = finite[scores[finite] == limit]
    level = level[np.argsort(ties[level], kind="stable")][: k - len(above)]
    return np.concatenate([above, level])


def units_of(vectors: pd.Series, size: int) -> np.ndarray:
    """Unit rows of the vectors of one length; zeros, which have cosine 0 with anything, for the others."""
    usable = np.array([v is not None and len(v) == size for v in vectors], dtype=bool)
    out = np.zeros((len(vectors), size))
    if usable.any():
        out[usable] = unit_rows(vectors[usable].tolist())
    return out


def _best(units: np.ndarray, given: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``given`` of the ``k`` highest rounded cosines of each query, and the cosines; -1 where there are fewer.

    Equal cosines go by place. A tile of products is compared with each query's ``k``-th best so far; only what reaches
    it is rounded and sorted in.
    """
    places, cosine = np.full((len(units), k), -1), np.full((len(units), k), np.nan)
    rounded = np.full((len(units), k), -np.inf)
    clean = np.isfinite(units).all() and np.isfinite(given).all()
    for start in range(0, len(given), TILE):
        scores = units @ given[start : start + TILE].T
        if not clean:
            scores[~np.isfinite(scores)] = -np.inf
        least = rounded[:, -1]
        if scores.shape[1] > k:
            # k of this tile reach it, too; what is nearly as high may round to the same.
            least = np.maximum(least, np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]) if start == 0 else least
        query, at = np.nonzero(scores >= least[:, None] - 2 * 10.0**-TIE_DIGITS)
        if not len(query):
            continue
        new = np.round(scores[query, at], TIE_DIGITS)
        old_query, old_at = np.nonzero(places >= 0)
        all_query = np.append(old_query, query)
        all_rounded = np.append(rounded[old_query, old_at], new)
        all_places = np.append(places[old_query, old_at], at + start)
        all_cosine = np.append(cosine[old_query, old_at], scores[query, at])
        order = np.lexsort((all_places, -all_rounded, all_query))
        all_query = all_query[order]
        nth = np.arange(len(order)) - np.searchsorted(all_query, all_query, "left")
        kept = (nth < k) & np.isfinite(all_rounded[order])
        order, all_query, nth = order[kept], all_query[kept], nth[kept]
        places[:], rounded[:], cosine[:] = -1, -np.inf, np.nan
        places[all_query, nth], rounded[all_query, nth], cosine[all_query, nth] = all_places[order], all_rounded[order], all_cosine[order]
    return places, cosine


def semantic_top_k(vectors: DataFrame, queries: DataFrame, k: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact ``k`` nearest ``vectors(vec_id, embedding)`` by cosine of ``queries(query_id, vector)``.

    Both sides are dealt into parts of about ``rows`` rows by their ids, and every part of one meets
    every part of the other in a cell. Vectors that are missing or of another length count as cosine 0;
    queries without a vector have no neighbours.
    """
    asked = queries.filter(F.size("vector") > 0).select("query_id", "vector")
    across = max(1, -(-asked.count() // rows))
    # Small libraries are cut finer, so that there is a cell for every core.
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    down = max(-(-vectors.count() // rows), -(-cores // across))

    def dealt(df: DataFrame, id: str, own: str, parts: int, other: str, copies: int) -> DataFrame:
        mine = F.pmod(F.xxhash64(id), F.lit(parts)).cast("int").alias(own)
        return df.select("*", mine, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias(other))

    ids = {name: df.schema[name].dataType.simpleString() for df, name in ((asked, "query_id"), (vectors, "vec_id"))}

    def nearest(library: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found = []
        library = library.sort_values("vec_id", kind="stable", ignore_index=True)
        vec_ids = library["vec_id"].to_numpy()
        for size, part in block.groupby(block["vector"].map(len)) if len(library) else ():
            asked, units = part["query_id"].to_numpy(), unit_rows(part["vector"].tolist())
            given = units_of(library["embedding"], int(size))
            for start in range(0, len(asked), ASKED):
                places, cosine = _best(units[start : start + ASKED], given, k)
                query, at = np.nonzero(places >= 0)
                found.append(pd.DataFrame({"query_id": asked[start : start + ASKED][query], "vec_id": vec_ids[places[query, at]], "cosine": cosine[query, at]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "cosine": []})

    left = dealt(vectors.select("vec_id", "embedding"), "vec_id", "row", down, "column", across)
    right = dealt(asked, "query_id", "column", across, "row", down)
    cells = left.groupBy("row", "column").cogroup(right.groupBy("row", "column"))
    best = Window.partitionBy("query_id").orderBy(F.round("cosine", TIE_DIGITS).desc(), "vec_id")
    return (
        cells.applyInPandas(nearest, f"query_id {ids['query_id']}, vec_id {ids['vec_id']}, cosine double")
        .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    )
