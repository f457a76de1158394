"""Cutting texts into overlapping windows, and picking chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from pagelens.functions.text import BLANKS

# Window size and overlap in words, windows per page, shortest chunk.
WINDOW, OVERLAP, PAGE_CAP = 420, 75, 36
LEAST_CHARS = 40
ID_STRIDE = 1_000_000
#: Texts of an Arrow batch that are cut at once.
SLICE = 500
#: ASCII characters that end a word in Python but are no blanks here.
ODD = frozenset("\x1c\x1d\x1e\x1f")


def chunk(
    documents: DataFrame, window: int = WINDOW, overlap: int = OVERLAP, cap: int | None = None
) -> DataFrame:
    """Rows ``(document_id, ord, text)`` from ``(document_id, text)``; no shuffle.

    The whole text is cut; ``cap`` limits the windows of one page (``PAGE_CAP`` is usual). A text with a
    single window of ``LEAST_CHARS`` characters or fewer is kept as it stands, blanks at its ends aside.
    """
    step = max(1, window - overlap)

    def pieces(text: str | None, blank: re.Pattern, ends: re.Pattern) -> list[str | None]:
        if text is None:
            return [None]
        words = words_of(text, blank)
        if not words:
            return []
        windows = 1 if len(words) <= window else -(-(len(words) - window) // step) + 1
        parts = (" ".join(words[i * step : i * step + window]) for i in range(windows if cap is None else min(windows, max(cap, 0) + 1)))
        kept = [p for p in parts if windows > 1 or len(p) > LEAST_CHARS][:cap]
        return kept or [ends.sub("", text)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Like ``strip``, whose pattern's end also comes before a last next-line character.
        blank, ends = re.compile(f"[{BLANKS}]+"), re.compile(f"\\A[{BLANKS}]+|[{BLANKS}]+(?=\x85?\\Z)")
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                at, ord_, texts = [], [], []
                for row, text in enumerate(batch.column(1).to_pylist()):
                    found = pieces(text, blank, ends)
                    at += [row] * len(found)
                    ord_ += range(len(found))
                    texts += found
                ids = batch.column(0).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(ord_, pa.int32()), pa.array(texts, pa.string())], ["document_id", "ord", "text"])

    rows = documents.select("document_id", "text")
    schema = StructType([rows.schema["document_id"]]).add("ord", IntegerType()).add("text", StringType())
    return rows.mapInArrow(cut, schema)


def words_of(text: str, blank: re.Pattern) -> list[str]:
    """The words between runs of blanks; what ``functions.text.words`` gives, in Python."""
    if text.isascii() and not ODD.intersection(text):
        return text.split()
    return [w for w in blank.split(text) if w]


def chunk_rows(documents: DataFrame, **options) -> DataFrame:
    """Chunks with ids that sort like (document_id, ord), waiting for their vectors."""
    return chunk(documents, **options).select(
        "document_id",
        (F.col("document_id") * ID_STRIDE + F.col("ord")).alias("chunk_id"),
        "ord",
        "text",
        F.lit(None).cast("array<float>").alias("embedding"),
        F.lit("pending").alias("embed_state"),
        F.lit(None).cast("string").alias("embed_model"),
        F.lit(None).cast("timestamp").alias("embed_updated_at"),
    )


def representative(chunks: DataFrame) -> DataFrame:
    """Longest chunk of each document, ties to the lowest id."""
    best = F.max_by(
        F.struct("chunk_id", "text"), F.struct(F.length("text"), -F.col("chunk_id"))
    )
    return (
        chunks.groupBy("document_id").agg(best.alias("best"))
        .select("document_id", "best.chunk_id", "best.text")
    )
