"""Shards of nearly equal size by sampled splitters.

Records are numbered and written once, and ordered by the hash of their text (copies lie side by side), then by
the hash of their id and number, so that no two are alike. A size-weighted sample of that order gives
quantile boundaries, the ranges between them are measured over all records, and ranges that hold more than
their share (one text in a third of the rows is a single value of the first hash) are subdivided by the
second. Prefix sums over the measured ranges tell which range each shard ends in; only those ranges are
looked into for the exact record.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm.common import free, stored

#: Ranges for each shard, ranges in all, and the bytes of a range that is not subdivided.
RANGES_PER_SHARD, MOST_RANGES, RANGE_BYTES = 16, 1024, 64 << 20
#: Sampled keys for each range.
SAMPLES = 8
#: Ranges up to which their table (under 40 bytes a row) is broadcast; beyond, it is joined by a shuffle.
BROADCAST_RANGES = 200_000

#: Splitters are places in this order.
ORDER = ["_range", "_part", "_h", "_u", "_no"]
OWN = ["_size", "_no", "_h", "_u", "_range", "_part", "_parts", "_row", "_first"]


def _even(hash: Column) -> Column:
    """A 64-bit hash as a number from 0 to 1, in the same order."""
    return hash.cast("double") / F.lit(2.0**64) + F.lit(0.5)


def _boundaries(keys: DataFrame, total: int, ranges: int) -> list[int]:
    """Quantiles of a sample that holds a key as often as its size makes its due."""
    due = F.col("_size") * F.lit(SAMPLES * ranges / total)
    drawn = keys.select("_h", F.floor(due + _even(F.xxhash64("_u", F.lit(1)))).cast("int").alias("times")).filter("times > 0")
    each = drawn.select("_h", F.explode(F.sequence(F.lit(1), F.col("times"))))
    steps = ", ".join(f"{i / ranges}D" for i in range(1, ranges))
    found = each.agg(F.expr(f"percentile_approx(_h, array({steps}), 100000)")).first()[0] if steps else None
    return sorted(set(found or []))


def shard(docs: DataFrame, shards: int = 8, id: str = "doc_id", text: str = "text", broadcast_ranges: int = BROADCAST_RANGES,
          range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``docs`` with ``size, law, shard, slot``, each range of records moved to one task.

    Law ``bytes``: with size the UTF-8 bytes of the text plus 1, the shards' sizes differ by at most
    the largest record. ``slot`` counts a shard's records from 0 without gaps.

    Null text: size 1, among the copies of one another. Null ids and repeated rows are records like
    any other, however many are alike. Equal texts share a shard unless they have more than its share or
    straddle its end. Empty table: no rows. Columns of ``docs`` named like the new ones are replaced; other
    columns stay, whatever their names.
    """
    given = [c for c in docs.columns if c.lower() not in ("size", "law", "shard", "slot")]
    # Names of this module's own are out of the way while it works.
    aside = {c: free(docs.select(*given), f"_kept{i}") for i, c in enumerate(given) if c.lower() in OWN}
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1
    numbered = docs.select(*[F.col(f"`{c}`").alias(aside.get(c, c)) for c in given], size.alias("_size"), F.xxhash64(F.col(text)).alias("_h"),
                           F.xxhash64(F.col(id)).alias("_u"), F.monotonically_increasing_id().alias("_no"))
    # Rows that are alike, or without an id, are told apart by their number, which has to be the same in every pass.
    keyed = stored(numbered.withColumn("_u", F.xxhash64("_u", "_no")), "records")
    keys = keyed.select("_h", "_u", "_no", "_size")
    total = keys.agg(F.sum("_size")).first()[0] or 1
    ranges = max(1, min(MOST_RANGES, max(shards * RANGES_PER_SHARD, total // range_bytes)))
    bounds = F.array(*[F.lit(b) for b in _boundaries(keys, total, ranges)]).cast("array<bigint>")
    most = min(range_bytes, max(1, 2 * total // ranges))

    def ranged(df: DataFrame) -> DataFrame:
        return df.withColumn("_range", F.size(F.filter(bounds, lambda b: b <= F.col("_h"))))

    # At most MOST_RANGES rows.
    parts = F.broadcast(stored(
        ranged(keys).groupBy("_range").agg(F.ceil(F.sum("_size") / F.lit(float(most))).cast("long").alias("_parts")), "ranges"))

    def parted(df: DataFrame) -> DataFrame:
        return ranged(df).join(parts, "_range").withColumn(
            "_part", F.least(F.floor(_even(F.col("_u")) * F.col("_parts")), F.col("_parts") - 1)).drop("_parts")

    before = Window.orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    measured = stored(
        parted(keys).groupBy("_range", "_part").agg(F.sum("_size").alias("_bytes"))
        .withColumn("_before", F.coalesce(F.sum("_bytes").over(before), F.lit(0))), "parts")

    # The record that holds the byte where a shard begins is its first.
    begins = F.explode(F.array(*[F.lit(k * total // shards) for k in range(1, shards)])) if shards > 1 else None
    splitters = []
    if begins is not None:
        ends = measured.select("*", begins.alias("_begin")).filter("_before <= _begin and _begin < _before + _bytes")
        running = Window.partitionBy("_range", "_part", "_begin").orderBy("_h", "_u", "_no").rowsBetween(Window.unboundedPreceding, 0)
        # At most a row for each shard but the first.
        inside = parted(keys).join(F.broadcast(ends), ["_range", "_part"]).withColumn("_end", F.col("_before") + F.sum("_size").over(running))
        splitters = [tuple(r) for r in inside.filter("_end - _size <= _begin and _begin < _end").select(*ORDER).collect()]

    place = F.struct(*[F.col(c).cast("long").alias(c) for c in ORDER])
    passed = [(place >= F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(ORDER, s, strict=True)])).cast("int") for s in splitters]

    def sharded(df: DataFrame) -> DataFrame:
        return parted(df).withColumn("shard", reduce(lambda a, b: a + b, passed, F.lit(0)))

    counts = sharded(keys).groupBy("shard", "_range", "_part").agg(F.count("*").alias("_n"))
    in_shard = Window.partitionBy("shard").orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    in_part = Window.partitionBy("_range", "_part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(
        counts.withColumn("_first", F.coalesce(F.sum("_n").over(in_shard), F.lit(0)) - F.coalesce(F.sum("_n").over(in_part), F.lit(0)))
        .select("shard", "_range", "_part", "_first"), "offsets")
    if offsets.count() <= broadcast_ranges:
        offsets = F.broadcast(offsets)

    number = F.row_number().over(Window.partitionBy("_range", "_part").orderBy("_h", "_u", "_no"))
    out = sharded(keyed).withColumn("_row", number).join(offsets, ["shard", "_range", "_part"])
    return out.select(*[F.col(aside.get(c, c)).alias(c) for c in given], F.col("_size").alias("size"), F.lit("bytes").alias("law"), "shard", (F.col("_first") + F.col("_row") - 1).alias("slot"))


def digest(records: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    return records.select(
        F.col(id).alias("doc_id"), "size", F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), "law", "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
