"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import discard, stored


def _lowest(links: DataFrame) -> DataFrame:
    """Each node with the lowest of its neighbours and itself; a hub's links are combined before the shuffle."""
    return links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``links (a, b)`` of comparable ids to ``node, root``: the lowest node reachable, for all nodes in links.

    Each round hangs a node's greater neighbours, then its smaller ones, under the lowest of them; the
    rounds needed grow with the logarithm of the nodes. Links of a node to itself and repeated ones
    do no harm; an empty table gives no rows.
    """
    now = stored(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while (state := _state(now)) != before:
        before = state
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_lowest(both), "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        small = large.join(large.groupBy("a").agg(F.min("b").alias("low")), "a")
        hung = small.select(F.col("b").alias("a"), F.col("low").alias("b")).unionAll(small.select("a", F.col("low").alias("b")))
        last, now = now, stored(hung.filter("a != b").distinct(), "links")
        discard(last)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
