"""Event-time windows, over streams and batches alike, and duplicates in streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, lateness: str, ts: str) -> DataFrame:
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, lateness) if events.isStreaming else timed


def windowed_counts(events: DataFrame, window: Column, lateness: str = "1 hour", ts: str = "ts", by: str = "event_type") -> DataFrame:
    """Rows and sum of value per window and `by`. On a stream, rows later than `lateness` behind are dropped. Rows
    without a time are in no window."""
    return _timed(events, lateness, ts).groupBy(window.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def tumbling(size: str, ts: str = "ts") -> Column:
    return F.window(ts, size)


def sliding(size: str, step: str, ts: str = "ts") -> Column:
    return F.window(ts, size, step)


def session(gap: str, ts: str = "ts") -> Column:
    """Windows that end when a key has no event for `gap`."""
    return F.session_window(ts, gap)


def first_of_each(events: DataFrame, keys: list[str], lateness: str = "1 hour", ts: str = "ts") -> DataFrame:
    """One event of each key: on a stream the first to come, its state kept for `lateness` of event time; in a batch the
    earliest one, of equal times the one of the least columns."""
    if events.isStreaming:
        return _timed(events, lateness, ts).dropDuplicatesWithinWatermark(keys)
    rest = [c for c in events.columns if c not in keys]
    least = events.groupBy(*keys).agg(F.min(F.struct(F.col(ts).alias("_ts"), *rest)).alias("_e"))
    return least.select(*[F.col(c) if c in keys else F.col("_e")[c].alias(c) for c in events.columns])
