"""Pages from a stream into a growing library, and vectors for chunks that wait for them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagelens.functions.urls import hostname
from pagelens.model import Policy
from pagelens.operators.vectors import embed_chunks
from pagelens.plans.ingest import clean_pages
from pagelens.streaming.events import drop_repeats
from pagelens.streaming.limits import rate_limit_stream
from pagelens.streaming.store import append_batch, append_outcomes

DRAIN = {"availableNow": True}


def query_of(batch: DataFrame, checkpoint: str) -> str:
    """The id that a checkpoint gave its query: batches of two streams, or of a fresh checkpoint, don't meet."""
    return json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()["value"])["id"]


def stream_ingest(
    pages: DataFrame,
    directory: str,
    checkpoint: str,
    policy: Policy,
    per_minute: int | None = None,
    lateness: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Gate, clean and append a stream ``pages(tenant_id, url, title, text | html, visited_at, seq)``.

    ``per_minute`` limits each tenant's calls per host before anything else is looked at
    (``LIMITS["index"]`` is usual; without it no call is refused); ``lateness`` turns on the suppression
    of repeated captures. What became of each page, refused ones included, is under ``outcomes``.
    """
    stream = pages.withColumn("allowed", F.lit(True))
    if lateness is not None:
        stream = drop_repeats(stream, lateness)
    if per_minute is not None:
        host_key = F.concat_ws("/", F.coalesce("tenant_id", F.lit(0)), hostname(F.col("url")))
        calls = stream.drop("allowed").withColumn("host_key", host_key).withColumn("ts", F.col("visited_at"))
        stream = rate_limit_stream(calls, "host_key", per_minute, order="seq").drop("host_key", "ts")

    def append(batch: DataFrame, batch_id: int) -> None:
        query = query_of(batch, checkpoint)
        cleaned = clean_pages(batch.filter("allowed").drop("allowed"), policy).persist()
        refused = batch.filter(~F.col("allowed")).withColumn("reason", F.lit("rate_limited"))
        append_outcomes(cleaned, refused, directory, batch_id, query)
        append_batch(cleaned.filter("reason is null"), directory, batch_id, query)
        cleaned.unpersist()

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or DRAIN)).start()


def stream_embed(
    chunks: DataFrame, target: str, checkpoint: str, as_of: Column, embedder=None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Vectors for a stream of pending chunks; a replayed batch replaces its own files."""
    options = {} if embedder is None else {"make_embedder": embedder}

    def embed(batch: DataFrame, batch_id: int) -> None:
        done = embed_chunks(batch, as_of, **options)
        done.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    writer = chunks.writeStream.foreachBatch(embed).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or DRAIN)).start()
