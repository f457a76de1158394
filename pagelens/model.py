"""Table schemas and the bundle of tables a library consists of."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("document_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("last_visited_at", T.TimestampType()),
    T.StructField("visit_count", T.IntegerType()),
    T.StructField("importance", T.DoubleType()),
])

CHUNKS = T.StructType([
    T.StructField("document_id", T.LongType()),
    T.StructField("chunk_id", T.LongType()),
    T.StructField("ord", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("embed_state", T.StringType()),
    T.StructField("embed_model", T.StringType()),
    T.StructField("embed_updated_at", T.TimestampType()),
])

VISITS = T.StructType([
    T.StructField("tenant_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("hostname", T.StringType()),
    T.StructField("visited_at", T.TimestampType()),
    T.StructField("text_length", T.IntegerType()),
])

POSTINGS = T.StructType([
    T.StructField("document_id", T.LongType()),
    T.StructField("chunk_id", T.LongType()),
    T.StructField("term", T.StringType()),
    T.StructField("tf", T.LongType()),
])

CONVERSATIONS = T.StructType([
    T.StructField("conversation_id", T.LongType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("title", T.StringType()),
])

CITED = T.StructType([
    T.StructField("chunk_id", T.LongType()),
    T.StructField("document_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
])

MESSAGES = T.StructType([
    T.StructField("conversation_id", T.LongType()),
    T.StructField("message_id", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("sent_at", T.TimestampType()),
    T.StructField("cited", T.ArrayType(CITED)),
    T.StructField("provider", T.StringType()),
])

DIGESTS = T.StructType([
    T.StructField("range", T.StringType()),
    T.StructField("generated_at", T.TimestampType()),
    T.StructField("page_count", T.LongType()),
    T.StructField("domains_count", T.LongType()),
    T.StructField("narrative", T.StringType()),
    T.StructField("topics", T.ArrayType(T.StructType([
        T.StructField("topic", T.StringType()),
        T.StructField("page_count", T.IntegerType()),
    ]))),
    T.StructField("insights", T.ArrayType(T.StructType([
        T.StructField("text", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("source_title", T.StringType()),
    ]))),
    T.StructField("sources", T.ArrayType(T.StructType([
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("visited_at", T.TimestampType()),
    ]))),
])

TABLES = {
    "documents": DOCUMENTS,
    "chunks": CHUNKS,
    "visits": VISITS,
    "conversations": CONVERSATIONS,
    "messages": MESSAGES,
    "digests": DIGESTS,
    "postings": POSTINGS,
}

# States of a chunk's vector; blank chunks are skipped.
PENDING, EMBEDDED, FAILED, SKIPPED = "pending", "embedded", "failed", "skipped"


@dataclass(frozen=True)
class Library:
    """The tables one library consists of; every job takes and returns these lazily."""

    documents: DataFrame
    chunks: DataFrame
    visits: DataFrame
    conversations: DataFrame | None = None
    messages: DataFrame | None = None
    digests: DataFrame | None = None
    #: The term index, if the library keeps one: ingest brings it up to date, searches use it.
    postings: DataFrame | None = None

    def with_tables(self, **tables: DataFrame) -> "Library":
        return replace(self, **tables)


@dataclass(frozen=True)
class Policy:
    """Owner settings for indexing. The domain tables have one column, ``domain``."""

    blocklist: DataFrame | None = None
    allowlist: DataFrame | None = None
    allowlist_only: bool = False
    paused: bool = False
