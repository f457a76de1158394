"""Browsing history: one row per address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions.text import nonempty, strip
from pagelens.functions.urls import hostname, strip_fragment

BLOCK = 100_000


def dedupe_history(history: DataFrame, as_of: Column, block: int = BLOCK) -> DataFrame:
    """Latest visit and best title of each address in ``history(url, title, visited_at, seq)``.

    In arrival order a row counts when its time is not before any earlier one; the title is the
    last non-empty one among rows that count. Within a block of arrivals only the last titled
    candidate can matter, since candidates' times never fall; a candidate stands when no earlier
    block reached a later time. So a single address with any number of rows is split by block.
    """
    rows = history.select(
        strip_fragment(F.col("url")).alias("url"),
        strip(F.coalesce("title", F.lit(""))).alias("title"),
        F.coalesce("visited_at", as_of).alias("visited_at"),
        "seq",
        F.floor(F.col("seq") / block).alias("block"),
    ).filter("url is not null")
    so_far = Window.partitionBy("url", "block").orderBy("seq").rowsBetween(
        Window.unboundedPreceding, 0
    )
    leading = rows.withColumn("_lead", F.col("visited_at") >= F.max("visited_at").over(so_far))
    titled = F.col("_lead") & (F.col("title") != "")
    blocks = leading.groupBy("url", "block").agg(
        F.max("visited_at").alias("latest"),
        F.max_by(F.struct("title", "visited_at"), F.when(titled, F.col("seq"))).alias("pick"),
    )
    earlier = Window.partitionBy("url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stands = F.col("pick.visited_at") >= F.coalesce(
        F.max("latest").over(earlier), F.col("pick.visited_at")
    )
    return (
        blocks.withColumn("_stands", stands)
        .groupBy("url")
        .agg(
            F.max_by("pick.title", F.when(F.col("_stands"), F.col("block"))).alias("title"),
            F.max("latest").alias("visited_at"),
        )
        .withColumn("title", F.coalesce(nonempty(F.col("title")), hostname(F.col("url"))))
    )


def history_slice(
    history: DataFrame, as_of: Column, days: int | None = 30, n: int | None = 300, raw_cap: int | None = None
) -> DataFrame:
    """Newest ``n`` addresses of the last ``days`` days; ``None`` for all.

    ``raw_cap`` lets only so many of the newest visits count, before addresses are told apart.
    """
    raw = history
    if days is not None:
        raw = raw.filter(F.col("visited_at") >= as_of - F.make_dt_interval(F.lit(days)))
    if raw_cap is not None:
        raw = raw.orderBy(F.col("visited_at").desc(), "seq").limit(raw_cap)
    found = dedupe_history(raw, as_of)
    return found if n is None else found.orderBy(F.col("visited_at").desc(), "url").limit(n)


def import_funnel(outcomes: DataFrame, total: int | None = None) -> DataFrame:
    """One row of counts from ``outcomes(outcome)``: indexed, skipped or fetch_failed."""
    def of(name: str) -> Column:
        return F.count_if(F.col("outcome") == name).alias(name)

    counts = outcomes.agg(
        F.count("*").alias("processed"), of("indexed"), of("skipped"), of("fetch_failed")
    )
    goal = F.col("processed") if total is None else F.lit(total).cast("long")
    share = F.floor(F.try_divide(100.0 * F.col("processed"), goal) + 0.5).cast("long")
    return counts.withColumn("total", goal).withColumn(
        "percent", F.least(F.lit(100), F.coalesce(share, F.lit(0)))
    )
