"""Rate limits on a stream: admitted times per key live in the state store."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagelens.operators.activity import WINDOW_MS, admit

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RECENT = T.StructType([T.StructField("times", T.ArrayType(T.LongType()))])


class Admission(StatefulProcessor):
    """Remembers at most ``limit`` admitted times of a key; refused calls leave no trace.

    With ``forgets``, a timer in event time clears a key that has had no admitted call for a whole window.
    """

    def __init__(self, order: str, limit: int, window_ms: int, forgets: bool = False):
        self.order, self.limit, self.window_ms, self.forgets = order, limit, window_ms, forgets

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getValueState("recent", RECENT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # Micro-batches arrive in order; within one, calls are decided in time order.
        batch = pd.concat(list(rows)).sort_values(["ts", self.order])
        times = batch["ts"].astype("datetime64[ms]").astype("int64")
        known = self.recent.get() if self.recent.exists() else None
        recent = deque(known[0] if known else ())
        batch["allowed"] = admit(times.to_numpy(), recent, self.limit, self.window_ms)
        self.recent.update(([int(t) for t in recent],))
        if self.forgets and recent:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(recent[-1]) + self.window_ms)
        yield batch

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        return iter([])

    def close(self) -> None:
        pass


def rate_limit_stream(
    calls: DataFrame, key: str, limit: int, window_ms: int = WINDOW_MS, order: str = "call_id", lateness: str | None = None
) -> DataFrame:
    """Adds ``allowed`` to a stream ``calls(key, ts, call_id)``.

    With ``lateness`` a key is forgotten once the watermark is a window past its last admitted call, and calls
    that come later than that are dropped; without it all keys are remembered and no call is dropped.
    """
    calls.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    out = T.StructType([*calls.schema.fields, T.StructField("allowed", T.BooleanType())])
    timed = calls if lateness is None else calls.withWatermark("ts", lateness)
    return (
        timed.groupBy(key)
        .transformWithStateInPandas(
            Admission(order, limit, window_ms, lateness is not None), outputStructType=out, outputMode="Append",
            timeMode="None" if lateness is None else "EventTime",
        )
    )
