"""Search evaluation set: one JSON file with a corpus, one with expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.model import Library


def read_eval(spark: SparkSession, corpus: str, queries: str) -> tuple[Library, DataFrame]:
    """Library and expectations; every document counts as visited at its last visit."""
    both = spark.read.option("multiLine", True).json(corpus)
    documents = both.select(F.inline("documents")).select(
        F.col("id").alias("document_id"), "url", "domain", "title", "summary",
        F.timestamp_millis("lastVisitedAt").alias("last_visited_at"),
        F.col("visitCount").cast("int").alias("visit_count"),
        F.col("importanceScore").cast("double").alias("importance"),
    )
    chunks = both.select(F.inline("chunks")).select(
        F.col("documentId").alias("document_id"), F.col("id").alias("chunk_id"),
        F.col("ord").cast("int").alias("ord"), "text",
        F.lit(None).cast("array<float>").alias("embedding"),
    )
    visits = documents.select("url", F.col("last_visited_at").alias("visited_at"))
    rows = spark.read.option("multiLine", True).schema(
        "query string, minHits int, topHitUrlIncludes string, anyHitUrlIncludes string, "
        "mustNotIncludeUrl string"
    ).json(queries)
    expectations = rows.select(
        F.xxhash64("query").alias("query_id"), F.col("query").alias("text"),
        F.col("minHits").alias("min_hits"), F.col("topHitUrlIncludes").alias("top_url"),
        F.col("anyHitUrlIncludes").alias("any_url"), F.col("mustNotIncludeUrl").alias("banned_url"),
    )
    return Library(documents, chunks, visits), expectations
