"""Event rates and sessions; windows and sessions take streams as well."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing_counts(events: DataFrame, seconds: int, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Each event with the number of its key's events in the trailing window, itself included.

    Time is cut into slots as long as the window. An event stands in its slot and, to be counted only, in the next one, so
    the work is spread over keys and slots, however few keys there are.
    """
    return _trailing(events, seconds, keys, F.unix_micros(F.col(ts).cast("timestamp")), F.min("__at")).drop("__found")


def _trailing(events: DataFrame, seconds: int, keys: Sequence[str], at: Column, found: Column) -> DataFrame:
    width = seconds * 1_000_000
    placed = events.withColumn("__at", at).withColumn("__slot", F.explode(F.array_distinct(F.array(F.floor(F.col("__at") / width), F.floor(F.col("__at") / width) + 1))))
    w = Window.partitionBy(*keys, "__slot").orderBy("__at").rangeBetween(-width, 0)
    counted = placed.withColumns({"in_window": F.count(F.lit(1)).over(w), "__found": found.over(w)})
    return counted.where(F.col("__slot").eqNullSafe(F.floor(F.col("__at") / width))).drop("__at", "__slot")


def trailing_rates(events: DataFrame, seconds: int, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Each event with ``in_window`` and ``per_second``: that number over the time since the window's first event, null where none has passed."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    counted = _trailing(events, seconds, keys, at, F.min("__at"))
    passed = (at - F.col("__found")) / 1_000_000
    return counted.withColumn("per_second", F.when(passed > 0, F.col("in_window") / passed)).drop("__found")


def windowed_counts(events: DataFrame, window: str, slide: str | None = None, keys: Sequence[str] = (), ts: str = "ts", late: str | None = None, value: str | None = None) -> DataFrame:
    """Counts (and sums) of tumbling or sliding windows; on a stream with a watermark, windows close when it has passed."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if late:
        rows = rows.withWatermark(ts, late)
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    sums = [F.sum(value).alias("total")] if value else []
    return rows.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("events"), *sums).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "events", *(["total"] if value else []))


def sessions(events: DataFrame, gap: str, keys: Sequence[str], ts: str = "ts", late: str | None = None) -> DataFrame:
    """Runs of a key's events that lie no further apart than the gap."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if late:
        rows = rows.withWatermark(ts, late)
    return rows.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "events")
