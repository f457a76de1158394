"""Term index of a library: which terms occur how often in which chunk."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from pagelens.functions import text as T
from pagelens.model import Library
from pagelens.operators.spread import broadcast_if_small
from pagelens.sources.tables import read_table, write_table


@dataclass(frozen=True)
class TermIndex:
    """``postings(document_id, chunk_id, term, tf)`` of the chunks' texts, with ``WHOLE_CHUNK`` as a term.

    Titles and summaries are short and change with every visit: they are counted when a search needs them.
    """

    postings: DataFrame


#: Stands for the chunk itself among its terms: every chunk holds it as often as it has tokens.
WHOLE_CHUNK = ""
#: Texts of an Arrow batch that are counted at once.
SLICE = 500
#: Documents whose postings are replaced and that are told to all tasks.
REPLACED = 2_000_000


def corpus(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Searchable text of each chunk with its document; chunks without a document drop out."""
    about = documents.select("document_id", "title", "summary")
    return (
        chunks.select("document_id", "chunk_id", "text")
        .join(about, "document_id")
        .select(
            "document_id", "chunk_id",
            T.corpus_text(F.col("title"), F.col("summary"), F.col("text")).alias("corpus"),
        )
    )


def heading(documents: DataFrame) -> DataFrame:
    """What a document adds to the searchable text of each of its chunks, and its title."""
    return documents.select("document_id", F.concat_ws("\n", "title", "summary").alias("text"), "title")


def chunk_lengths(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Length of each chunk in tokens, at least one; tokens are counted where the texts lie."""
    size = F.size(T.tokens(F.coalesce("text", F.lit(""))))
    own = chunks.select("document_id", "chunk_id", size.alias("own"))
    above = heading(documents).select("document_id", size.alias("above"))
    return own.join(above, "document_id").select(
        "document_id", "chunk_id", F.greatest(F.col("own") + F.col("above"), F.lit(1)).cast("long").alias("dl"))


def _tallied(texts: list[str]) -> tuple[list[int], list[str], list[int]]:
    """Number of terms of each text, all texts' terms one after the other, and how often each occurs."""
    token = re.compile("[a-z0-9]{2,}")
    sizes, found, times = [], [], []
    for text in texts:
        tokens = token.findall(text)
        counts = Counter(tokens)
        sizes.append(len(counts) + 1)
        found += [*counts, WHOLE_CHUNK]
        times += [*counts.values(), len(tokens)]
    return sizes, found, times


def _counts(texts: DataFrame, keys: list[str], terms: DataFrame | None) -> DataFrame:
    """``keys, term, tf`` of each text by itself; the whole text counts as often as it has tokens.

    Texts with the same keys are not summed up yet.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                sizes, found, times = _tallied(batch.column(len(keys)).to_pylist())
                at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).take(at) for i in range(len(keys))], pa.array(found, pa.string()), pa.array(times, pa.int64())], [*keys, "term", "tf"])

    rows = texts.select(*keys, F.lower(F.coalesce("text", F.lit(""))).alias("_text"))
    schema = StructType([rows.schema[k] for k in keys]).add("term", StringType()).add("tf", LongType())
    counted = rows.mapInArrow(count, schema)
    return counted if terms is None else counted.join(F.broadcast(terms), "term")


def listed(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, terms, tfs``: one row for each text, its terms and how often each occurs, with the whole text among them; no shuffle.

    The keys tell texts apart: texts with the same keys are not summed up.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                sizes, found, times = _tallied(batch.column(len(keys)).to_pylist())
                ends = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i) for i in range(len(keys))], pa.ListArray.from_arrays(ends, pa.array(found, pa.string())), pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))],
                    [*keys, "terms", "tfs"])

    rows = texts.select(*keys, F.lower(F.coalesce("text", F.lit(""))).alias("_text"))
    schema = StructType([rows.schema[k] for k in keys]).add("terms", ArrayType(StringType())).add("tfs", ArrayType(LongType()))
    return rows.mapInArrow(count, schema)


def _summed(counted: DataFrame, keys: list[str]) -> DataFrame:
    """One row per text and term. Terms are counted where a text lies, so rows are dealt by text, once for all later groupings by it."""
    return counted.repartition(*keys).groupBy(*keys, "term").agg(F.sum("tf").alias("tf"))


def text_postings(chunks: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Occurrences of each term in each chunk's text."""
    keys = ["document_id", "chunk_id"]
    return _summed(_counts(chunks, keys, terms), keys)


def term_freq(documents: DataFrame, chunks: DataFrame, terms: DataFrame | None = None, own: DataFrame | None = None) -> DataFrame:
    """Occurrences of each term in each chunk; with a small ``terms(term)``, of those only.

    No token runs over from title or summary into the text, so each is counted where it lies and only
    counts are joined; ``own`` are the texts' postings if they are known. ``WHOLE_CHUNK`` counts as a term of
    every chunk, as often as the chunk has tokens, so that lengths and chunk numbers come out of the same
    pass over the texts. Chunks without a document drop out.
    """
    keys = ["document_id", "chunk_id"]
    if own is None:
        own, places = _counts(chunks, keys, terms), chunks.select(*keys).distinct()
    else:
        places = own.filter(F.col("term") == WHOLE_CHUNK).select(*keys)
    above = _summed(_counts(heading(documents), ["document_id"], terms), ["document_id"])
    spread = above.join(places, "document_id")
    known = own.join(documents.select("document_id"), "document_id", "left_semi")
    return _summed(known.select(*keys, "term", "tf").unionByName(spread.select(*keys, "term", "tf")), keys)


def doc_freq(postings: DataFrame) -> DataFrame:
    """Chunks that hold each term."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: number of chunks and their mean length."""
    return lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def build_index(library: Library) -> TermIndex:
    return TermIndex(text_postings(library.chunks))


def replace_postings(postings: DataFrame, fresh: DataFrame, documents: DataFrame) -> DataFrame:
    """Postings after the listed documents got new chunks, whose postings are ``fresh``; nothing else is counted again."""
    # Eight bytes for each document: postings stay where they are as long as those fit.
    gone = broadcast_if_small(documents.select("document_id").distinct(), REPLACED)
    kept = postings.join(gone, "document_id", "left_anti")
    return kept.unionByName(fresh.select(postings.columns))


def write_index(index: TermIndex, directory: str) -> None:
    """Store the postings sorted by term, so a search reads only its own terms' row groups."""
    write_table(index.postings, directory, "postings")


def read_index(spark: SparkSession, directory: str) -> TermIndex:
    return TermIndex(read_table(spark, directory, "postings"))
