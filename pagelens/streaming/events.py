"""Event-time operators on streams: repeats, quiet periods, activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATENESS = "10 minutes"


def drop_repeats(pages: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Captures of the same page with the same text within the watermark count once."""
    return (
        pages.withColumn("_digest", F.xxhash64("text"))
        .withWatermark("visited_at", lateness)
        .dropDuplicatesWithinWatermark(["url", "_digest"])
        .drop("_digest")
    )


def idle_capture_stream(
    events: DataFrame, key: str, gap: str, lateness: str = LATENESS, order: str = "event_id"
) -> DataFrame:
    """Last event of each session of a key; a session ends after ``gap`` without events."""
    payload = F.struct(*events.columns)
    return (
        events.withWatermark("ts", lateness)
        .groupBy(key, F.session_window("ts", gap))
        .agg(F.max_by(payload, F.struct("ts", order)).alias("last"))
        .select("last.*")
    )


def visit_activity_stream(visits: DataFrame, width: str = "1 day", lateness: str = LATENESS) -> DataFrame:
    """Visits and roughly distinct pages per tumbling window."""
    return (
        visits.withWatermark("visited_at", lateness)
        .groupBy(F.window("visited_at", width).alias("w"))
        .agg(F.count("*").alias("visits"), F.approx_count_distinct("url").alias("pages"))
        .select(F.col("w.start").alias("start"), "visits", "pages")
    )
