"""Visit activity: rate limits, quiet periods, tumbling windows."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.operators.spread import is_small, next_value, running
from pagelens.session import written

WINDOW_MS = 60_000
#: Windows in a piece of a run without a pause, and rounds in which pieces are decided from what the ones before leave behind.
PIECE, ROUNDS = 64, 6
#: Calls up to which a run is not cut: a task gets through so many at once.
LONG = 20_000
#: A sketch of distinct values has this power of two of places; the usual error is 1.6 %.
SKETCH_BITS = 12
# Allowed calls per minute for each kind of request.
LIMITS = {"index": 30, "chat": 10, "search": 60, "digest": 5, "import": 1}


def admit(times: np.ndarray, recent: deque, limit: int, window_ms: int = WINDOW_MS) -> np.ndarray:
    """Decide calls in time order, given the admitted ones still inside the window.

    Refused calls leave no trace, so the decision depends on admitted calls only.
    """
    allowed = np.zeros(len(times), dtype=bool)
    for i, t in enumerate(times):
        while recent and t - recent[0] >= window_ms:
            recent.popleft()
        if len(recent) < limit:
            recent.append(t)
            allowed[i] = True
    return allowed


def rate_limit(
    calls: DataFrame, key: str, limit: int, window_ms: int = WINDOW_MS, order: str = "call_id"
) -> DataFrame:
    """Adds ``allowed`` to ``calls(key, ts, call_id)``.

    A pause of a whole window clears a key's state, so calls are cut into runs at such pauses.
    Runs of at most ``limit`` calls are all allowed without any ordering work. Those of more than ``LONG`` are cut into pieces of
    ``PIECE`` windows, each decided for itself from what the piece before leaves behind: nothing at first, then
    what it left in the last round, until no piece is left anything else. Runs that still change after ``ROUNDS``
    rounds are streamed in time order through a task that remembers ``limit`` times, never a whole key.
    A null key is a key like others; calls without a time are refused.
    """
    undated = calls.filter("ts is null").withColumn("allowed", F.lit(False))
    timed = calls.filter("ts is not null").withColumn("_ms", F.unix_millis("ts")).withColumn(
        "_bucket", F.date_trunc("HOUR", "ts")
    )
    after = [F.col("_ms"), F.col(order)]
    ends = next_value(timed, [key], "_bucket", after, "_ms", "_next")
    last = (F.col("_next").isNull() | (F.col("_next") - F.col("_ms") >= window_ms)).cast("long")
    runs = running(ends, [key], "_bucket", after, {"_ended": last})
    runs = runs.withColumn("_run", F.to_json(F.struct(key, (F.col("_ended") - last).alias("_run"))))
    runs = runs.withColumn("_piece", F.floor(F.col("_ms") / (PIECE * window_ms)))
    runs = written(runs.select(*calls.columns, "_ms", "_run", "_piece"))
    sizes = runs.groupBy("_run").agg(F.count("*").alias("_size"), ((F.max("_piece") > F.min("_piece")) & (F.count("*") > LONG)).alias("_long"))
    sized = runs.join(sizes, "_run")

    quiet = sized.filter(F.col("_size") <= limit).select(*calls.columns, F.lit(True).alias("allowed"))
    busy = sized.filter(F.col("_size") > limit).drop("_size")
    short, long_ = busy.filter("not _long").drop("_long"), busy.filter("_long").drop("_long")
    none = F.array().cast("array<long>").alias("_recent")
    whole = short.select("*", none).withColumn("_piece", F.lit(0).cast("long"))
    if not is_small(long_, 0):
        carried, unsettled = settled(long_, limit, window_ms, order)
        far = long_.join(unsettled, "_run", "left_semi").select("*", none).withColumn("_piece", F.lit(0).cast("long"))
        pieces = long_.join(unsettled, "_run", "left_anti").join(carried, ["_run", "_piece"])
        whole = whole.unionByName(far).unionByName(pieces.select(whole.columns))
    decided = _in_order(whole, order).mapInPandas(_decide(limit, window_ms, calls.columns), quiet.schema)
    return quiet.unionByName(decided).unionByName(undated)


def _in_order(rows: DataFrame, order: str) -> DataFrame:
    return rows.repartition("_run", "_piece").sortWithinPartitions("_run", "_piece", "_ms", order)


def _decide(limit: int, window_ms: int, columns: list[str] | None):
    """Decides rows sorted by piece and time, each piece from its ``_recent``.

    With ``columns`` the calls come back with ``allowed``, without them one row per piece: its ``_left``.
    """

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, recent = None, deque()

        def left():
            return pd.DataFrame({"_run": [current[0]], "_piece": [current[1]], "_left": [list(recent)]})

        for batch in batches:
            verdicts = []
            starts = (batch["_run"].ne(batch["_run"].shift()) | batch["_piece"].ne(batch["_piece"].shift())).cumsum()
            for _, part in batch.groupby(starts, sort=False):
                piece = (part["_run"].iat[0], part["_piece"].iat[0])
                if piece != current:
                    if current is not None and columns is None:
                        yield left()
                    current, recent = piece, deque(int(t) for t in part["_recent"].iat[0])
                verdicts.append(admit(part["_ms"].to_numpy(), recent, limit, window_ms))
            if columns is not None:
                out = batch[list(columns)].copy()
                out["allowed"] = np.concatenate(verdicts) if verdicts else []
                yield out
        if current is not None and columns is None:
            yield left()

    return decide


def settled(rows: DataFrame, limit: int, window_ms: int, order: str, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What each piece of a run starts with, ``(_run, _piece, _recent)``, and the runs for which that isn't known yet.

    A piece starts with the admitted times that the one before leaves behind and that its first call still sees. Only
    pieces that start with something else than in the last round are decided again.
    """
    firsts = written(rows.groupBy("_run", "_piece").agg(F.min("_ms").alias("_first")))
    before = Window.partitionBy("_run").orderBy("_piece")  # a row for each piece that has calls
    none = F.array().cast("array<long>")
    carried = firsts.select("_run", "_piece", none.alias("_recent"))
    lefts, todo = None, carried
    for _ in range(ROUNDS if rounds is None else rounds):
        calls = rows.join(todo.select("_run", "_piece", "_recent"), ["_run", "_piece"])
        new = _in_order(calls, order).mapInPandas(_decide(limit, window_ms, None), "_run string, _piece long, _left array<long>")
        kept = new if lefts is None else lefts.join(todo, ["_run", "_piece"], "left_anti").unionByName(new)
        lefts = written(kept)
        came = F.coalesce(F.lag("_left").over(before), none)
        seen = F.filter("_came", lambda t: F.col("_first") - t < window_ms)
        following = firsts.join(lefts, ["_run", "_piece"]).withColumn("_came", came).select("_run", "_piece", seen.alias("_now"))
        compared = written(following.join(carried, ["_run", "_piece"]))
        carried = compared.select("_run", "_piece", F.col("_now").alias("_recent"))
        todo = compared.filter(F.col("_now") != F.col("_recent")).select("_run", "_piece", F.col("_now").alias("_recent"))
        if is_small(todo, 0):
            break
    return carried, todo.select("_run").distinct()


def idle_capture(events: DataFrame, key: str, gap_seconds: int, order: str) -> DataFrame:
    """Last event of each quiet period: nothing of the same key follows within the gap.

    A null key is a key like others; events without a time belong to no period.
    """
    timed = events.filter("ts is not null").withColumn("_bucket", F.date_trunc("DAY", "ts"))
    followed = next_value(timed, [key], "_bucket", [F.col("ts"), F.col(order)], "ts", "_next")
    pause = F.unix_micros("_next") - F.unix_micros("ts")
    quiet = F.col("_next").isNull() | (pause >= gap_seconds * 1_000_000)
    return followed.filter(quiet).drop("_bucket", "_next")


def visit_activity(visits: DataFrame, width: str = "1 day") -> DataFrame:
    """Visits per tumbling window."""
    return (
        visits.groupBy(F.window("visited_at", width).alias("w"))
        .agg(F.count("*").alias("visits"), F.count_distinct("url").alias("pages"))
        .select(F.col("w.start").alias("start"), "visits", "pages")
    )


def daily_sketches(visits: DataFrame) -> DataFrame:
    """``day, domain, visits, pages``: visits of each day and domain, and a sketch of their distinct pages.

    Sketches are a few KB whatever the traffic, and those of any days and domains can be united.
    """
    return visits.groupBy(F.to_date("visited_at").alias("day"), F.col("hostname").alias("domain")).agg(
        F.count("*").alias("visits"), F.hll_sketch_agg("url", F.lit(SKETCH_BITS)).alias("pages"))


def sketched_counts(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Visits and about how many distinct pages, for any grouping of the days and domains, without the visits."""
    return sketches.groupBy(*keys).agg(
        F.sum("visits").alias("visits"), F.hll_sketch_estimate(F.hll_union_agg("pages")).alias("pages"))


def period_counts(documents: DataFrame, start: Column, end: Column) -> DataFrame:
    """Pages and distinct domains last visited in a period."""
    return documents.filter(F.col("last_visited_at").between(start, end)).agg(
        F.count("*").alias("page_count"), F.count_distinct("domain").alias("domains_count")
    )
