"""The shared test tables as a library (see FIXTURES.md for the mapping)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions import text as T
from pagelens.functions import urls as U
from pagelens.model import Library
from pagelens.operators.chunks import chunk_rows
from pagelens.operators.spread import is_small
from pagelens.session import written, use_utc
from pagelens.sources.tables import balanced

AS_OF_MS = 1_706_659_200_000
#: Numbers of documents with a vector (8 bytes each) that tasks get; with more, all texts are shuffled to meet their vectors.
VECTOR_IDS = 4_000_000


def as_of() -> Column:
    return F.timestamp_millis(F.lit(AS_OF_MS))


# Tables of long texts, and the key their rows are spread by when they come in one piece.
TEXTS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = use_utc(spark).read.parquet(f"{sf}/{name}.parquet")
    return balanced(df, TEXTS[name]) if name in TEXTS else df


def documents(spark: SparkSession, sf: str, with_text: bool = False) -> DataFrame:
    raw = table(spark, sf, "documents")
    domain = F.concat("source", F.lit(".example"))
    age = F.make_dt_interval((F.col("doc_id") % 90).cast("int"))
    columns = [
        F.col("doc_id").alias("document_id"),
        F.concat(F.lit("https://"), domain, F.lit("/"), F.col("doc_id")).alias("url"),
        domain.alias("domain"),
        F.substring("text", 1, 60).alias("title"),
        T.excerpt(F.col("text")).alias("summary"),
        (as_of() - age).alias("last_visited_at"),
        F.lit(1).alias("visit_count"),
        ((F.col("doc_id") % 100) / F.lit(100.0)).alias("importance"),
    ]
    return raw.select(*columns, *(["text"] if with_text else []))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts in windows; the vector with the document's number belongs to its first chunk.

    Texts of documents without a vector are cut where they lie: only the others are shuffled to meet theirs.
    """
    raw = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text")
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("document_id"), F.lit(0).alias("ord"), "embedding"
    )

    def cut(texts: DataFrame) -> DataFrame:
        return chunk_rows(texts, cap=None).drop("embedding", "embed_state", "embed_model")

    ids = vectors.select("document_id").distinct()
    if is_small(ids, VECTOR_IDS):
        pending, raw = (raw.join(F.broadcast(ids), "document_id", how) for how in ("left_anti", "left_semi"))
        pending = cut(pending).withColumn("embedding", F.lit(None).cast(vectors.schema["embedding"].dataType))
    else:
        pending = None
    joined = cut(raw).join(vectors, ["document_id", "ord"], "left")
    every = joined if pending is None else joined.unionByName(pending)
    return every.select(
        "document_id", "chunk_id", "ord", "text", "embedding",
        F.when(F.col("embedding").isNull(), "pending").otherwise("embedded").alias("embed_state"),
        F.when(F.col("embedding").isNotNull(), "given-64").alias("embed_model"),
        "embed_updated_at",
    )


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def visits(spark: SparkSession, sf: str) -> DataFrame:
    """Each event is a visit to the document whose number it falls on."""
    docs = table(spark, sf, "documents").select("doc_id", "source", F.col("n_chars").cast("int").alias("n"))
    total = docs.count()
    hits = _events(spark, sf).withColumn("doc_id", F.col("event_id") % total).join(docs, "doc_id")
    domain = F.concat("source", F.lit(".example"))
    return hits.select(
        F.col("user_id").alias("tenant_id"),
        F.concat(F.lit("https://"), domain, F.lit("/"), F.col("doc_id")).alias("url"),
        F.col("event_type").alias("title"),
        domain.alias("hostname"),
        F.col("ts").alias("visited_at"),
        F.col("n").alias("text_length"),
    )


def page_visits(spark: SparkSession, sf: str) -> DataFrame:
    """Each event is a visit to the raw page whose number it falls on, in arrival order ``seq``."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    total = pages.count()
    hits = _events(spark, sf).withColumn("page_id", F.col("event_id") % total).join(pages, "page_id")
    named = F.when(F.col("event_type") == "error", F.lit("")).otherwise(
        F.concat(F.col("event_type"), F.lit(" "), F.col("page_id"))
    )
    return hits.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("tenant_id"),
        "url",
        U.hostname(F.col("url")).alias("domain"),
        named.alias("title"),
        F.col("props").alias("summary"),
        F.col("ts").alias("visited_at"),
    )


@lru_cache(maxsize=4)
def _stored(app: str, sf: str) -> Library:
    spark = SparkSession.builder.getOrCreate()
    return Library(
        written(documents(spark, sf)), written(chunks(spark, sf)), written(visits(spark, sf))
    )


def library(spark: SparkSession, sf: str) -> Library:
    """The library as stored tables, written once per session: a search does not cut texts anew."""
    return _stored(use_utc(spark).sparkContext.applicationId, sf)


def queries(spark: SparkSession, sf: str, vectors: bool = False) -> DataFrame:
    """Every benchmark passage is a query; with ``vectors``, the vector of the same number too."""
    out = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    if not vectors:
        return out
    given = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")
    )
    return out.join(given, "query_id", "left")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "conversations").filter("role <> 'system'")
    back = F.make_dt_interval(F.lit(0), F.lit(0), (F.lit(1000) - F.col("turn")).cast("int"))
    return raw.select(
        F.col("conv_id").alias("conversation_id"),
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("message_id"),
        "role",
        F.col("text").alias("content"),
        (as_of() - back).alias("sent_at"),
    )


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Titled after the first message a user wrote."""
    asked = messages(spark, sf)
    first = F.min_by("content", F.when(F.col("role") == "user", F.col("message_id")))
    return asked.groupBy("conversation_id").agg(
        F.min("sent_at").alias("created_at"),
        F.max("sent_at").alias("updated_at"),
        T.conversation_title(F.coalesce(first, F.lit(""))).alias("title"),
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).filter("role = 'user'").select(
        F.col("message_id").alias("question_id"), F.col("content").alias("question")
    )


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Page visits as raw history rows, with fragments and empty titles as they come."""
    return page_visits(spark, sf).select("url", "title", "visited_at", "seq")
