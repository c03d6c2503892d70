"""Counts and rates of each event's trailing window, on a stream: keyed state that event-time timers evict."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Keyed state with lists and timers needs this provider (setting, value).
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Windows of a slot of time: a key's slot is a group, to which the window before it is copied.
SLOT_WINDOWS = 16


class TrailingWindow(StatefulProcessor):
    """A key's events of a slot of time, with those of the window before it. State: their times, as microseconds."""

    def __init__(self, width: int, slot: int, columns: list[str], given: list[str]) -> None:
        self.width, self.slot, self.columns, self.given = width, slot, columns, given

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        new.columns = self.given  # names that begin with an underscore don't arrive
        at = np.sort(new["__at"].to_numpy(np.int64))
        old = np.array([r[0] for r in self.seen.get()], np.int64) if self.seen.exists() else at[:0]
        if not len(old):  # no event of this slot is taken any more when the watermark has passed its end
            self.handle.registerTimer((int(key[-1]) + 1) * self.slot // 1000)
        self.seen.appendList([(int(t),) for t in at])
        every = np.sort(np.concatenate([old, at]))
        own = new[new["__own"]].reset_index(drop=True)
        times = own["__at"].to_numpy(np.int64)
        first = np.searchsorted(every, times - self.width, "left")
        out = own[self.columns].copy()
        out["in_window"] = np.searchsorted(every, times, "right") - first
        passed = times - every[np.minimum(first, max(len(every) - 1, 0))] if len(times) else times
        out["per_second"] = np.where(passed > 0, out["in_window"] / (np.maximum(passed, 1) / 1_000_000), np.nan)
        yield out

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def trailing_stream(events: DataFrame, seconds: int, keys: Sequence[str], ts: str = "ts", late: int = 600) -> DataFrame:
    """Each arriving event with ``in_window`` (its key's events in the trailing window that have arrived, itself included) and ``per_second``.

    The same as ``rates.trailing_rates`` where events arrive in the order of their times, in batches of any size. An event
    that is late by ``late`` seconds or less counts what has arrived, and is counted by what comes after it; rows that were
    given out stay as they are. A later one is dropped, as by every stateful operator. Events without a time are dropped.
    State is held by key and slot of ``SLOT_WINDOWS`` windows, so that one key's events are spread over slots, and a slot's state goes with
    the watermark: it doesn't grow with the stream. The session's state store must be ``STATE_STORE``.
    """
    width = seconds * 1_000_000
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).where(F.col(ts).isNotNull()).withWatermark(ts, f"{late} seconds")
    size = SLOT_WINDOWS * width
    slot = F.floor(F.col("__at") / size)
    near = F.when(F.col("__at") + width >= (slot + 1) * size, F.array(slot, slot + 1)).otherwise(F.array(slot))
    rows = rows.withColumn("__at", F.unix_micros(ts)).withColumn("__slot", F.explode(near)).withColumn("__own", F.col("__slot") == slot)
    schema = events.withColumn(ts, F.col(ts).cast("timestamp")).schema.add("in_window", "long").add("per_second", "double")
    out = rows.groupBy(*keys, "__slot").transformWithStateInPandas(TrailingWindow(width, size, events.columns, rows.columns), schema, "Append", "EventTime")
    return out.withColumn("per_second", F.nanvl("per_second", F.lit(None).cast("double")))
