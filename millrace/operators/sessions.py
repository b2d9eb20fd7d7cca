"""Sessions: runs of events of a key with no gap above a bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.prefix import ONE_TASK_ROWS, running_sums
from millrace.storage import materialize


def sessionize(events: DataFrame, key: str, ts: str, gap_seconds: int, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """events with session_no, counting each key's sessions from 1. Events without a time are in the key's first session,
    and so is the first event with one. Rows of a null key are one key. A column named session_no gives way.

    An event opens a session if none of the key's events reaches it with its gap: a sweep over events and the ends of
    their gaps, then a count of those that open one. Both are sums over sorted ranges; a key's events are in no one task."""
    events = events.drop("session_no")
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(events.columns)])
    plain = events.select(F.col(key).alias("_key"), F.col(ts).alias("_at"), row.alias("_row"))
    timed = plain.where("_at is not null")
    ends = timed.select("_key", (F.col("_at") + F.expr(f"interval {gap_seconds} seconds")).alias("_at"), F.lit(None).cast(plain.schema["_row"].dataType).alias("_row"), F.lit(-1).cast("long").alias("_d"))
    both = timed.withColumn("_d", F.lit(1).cast("long")).unionByName(ends)
    swept = running_sums(both, [F.col("_at"), F.desc("_d")], {"_open": F.col("_d")}, ("_key",), one_task_rows)
    flagged = materialize(swept.where("_d = 1").select("_key", "_at", "_row", (F.col("_open") == 0).cast("long").alias("_new")), "events")
    numbered = running_sums(flagged, [F.col("_at"), F.desc("_new")], {"_no": F.col("_new")}, ("_key",), one_task_rows)
    every = numbered.select("_row", (F.col("_no") + F.col("_new")).alias("session_no")).unionByName(plain.where("_at is null").select("_row", F.lit(1).cast("long").alias("session_no")))
    return every.select(*[F.col("_row")[f"c{k}"].alias(c) for k, c in enumerate(events.columns)], "session_no")
