"""Skew-safe versions of grouped ordering.

A window function puts every row of a key into one task. The operators here first work on
slices of a key (a salt or an ordered bucket) and then combine one small row per slice, so a key
that holds a third of the table is still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def _window(keys: Sequence[str | Column], order: Sequence[Column]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def top_n(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    spread_by: str,
    rank: str = "rank",
) -> DataFrame:
    """First ``n`` rows of each key, numbered from 1 in column ``rank``.

    The first pass keeps ``n`` rows of each slice of a key, the second ``n`` of at most
    ``SALTS * n``; a row among a key's first ``n`` is among its slice's first ``n``.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)))
    part = salted.withColumn(rank, F.row_number().over(_window([*keys, "_salt"], order)))
    kept = part.filter(F.col(rank) <= n).drop("_salt", rank)
    return kept.withColumn(rank, F.row_number().over(_window(keys, order))).filter(F.col(rank) <= n)


def _place(keys: Sequence[str], bucket: str) -> Column:
    """Key and bucket as one value that is never null, so that joins by equality lose none."""
    return F.struct(*keys, bucket).alias("_place")


def bucket_totals(
    df: DataFrame, keys: Sequence[str], bucket: str, sums: dict[str, Column], descending: bool = False
) -> DataFrame:
    """One row per key and bucket: its totals, and the totals of the buckets before it."""
    totals = df.groupBy(*keys, bucket).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    ordered = F.col(bucket).desc() if descending else F.col(bucket).asc()
    before = _window(keys, [ordered]).rowsBetween(Window.unboundedPreceding, -1)
    for name in sums:
        totals = totals.withColumn(
            f"{name}_before", F.coalesce(F.sum(name).over(before), F.lit(0).cast("long"))
        )
    return totals


def running(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[Column],
    sums: dict[str, Column],
    descending: bool = False,
) -> DataFrame:
    """Running sums per key up to and including each row.

    ``bucket`` must be monotone in ``order``. Each bucket is summed by itself; the sums of the
    earlier buckets come from one row per key and bucket. Null keys and buckets count like others.
    """
    totals = bucket_totals(df, keys, bucket, sums, descending)
    offsets = totals.select(_place(keys, bucket), *[f"{name}_before" for name in sums])
    inside = _window(["_place"], order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_place", _place(keys, bucket))
    for name, value in sums.items():
        out = out.withColumn(name, F.sum(value).over(inside))
    out = out.join(offsets, "_place").drop("_place")
    for name in sums:
        out = out.withColumn(name, F.col(name) + F.col(f"{name}_before")).drop(f"{name}_before")
    return out


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[Column],
    name: str,
    descending: bool = False,
) -> DataFrame:
    """Position of each row within its key, from 1."""
    return running(df, keys, bucket, order, {name: F.lit(1).cast("long")}, descending)


def next_value(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column], value: str, name: str
) -> DataFrame:
    """``value`` of the following row of the same key, looked up across buckets; null at the end."""
    firsts = df.groupBy(*keys, bucket).agg(F.min(value).alias("_first"))
    over = _window(keys, [F.col(bucket)])
    following = firsts.withColumn("_following", F.lead("_first").over(over)).select(_place(keys, bucket), "_following")
    return (
        df.withColumn("_place", _place(keys, bucket))
        .withColumn(name, F.lead(value).over(_window(["_place"], order)))
        .join(following, "_place")
        .withColumn(name, F.coalesce(F.col(name), F.col("_following")))
        .drop("_following", "_place")
    )


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it needs to know that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Broadcast a side that is proven small; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if is_small(df, rows) else df
