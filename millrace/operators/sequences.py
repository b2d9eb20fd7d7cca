"""Patterns over each key's ordered rows: funnels with gaps, a negation and a time limit.

Of an automaton over the rows only the latest start of each state matters, and later starts are the larger ones. So a
state is a running maximum, carried over sorted ranges; one sweep for each step, and no key in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.prefix import ONE_TASK_ROWS, running_max
from millrace.storage import materialize


def funnel(events: DataFrame, by: list[str], ts: str, tie: str, steps: list[Column], seconds: int, without: Column | None = None, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """(by, first, last, first_ts, last_ts) for each row that ends the sequence of steps within so many seconds: rows of a
    key that satisfy the steps one after the other, others between them, but none that satisfies `without`. first is the
    `tie` of the latest row that such a sequence begins with, last that of the row that ends it.

    Rows are in the order of ts and tie, which together tell a key's rows apart; a row takes one step at most. Rows with
    a null ts, tie or key are left out, and so are rows for which a step is null. At least two steps."""
    if len(steps) < 2:
        raise ValueError("a funnel has two steps at least")
    at = F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"))
    known = F.col(ts).isNotNull() & F.col(tie).isNotNull()
    for b in by:
        known = known & F.col(b).isNotNull()
    flags = [F.coalesce(s, F.lit(False)).alias(f"_s{k}") for k, s in enumerate(steps)]
    rows = events.where(known).select(*by, at.alias("_at"), *flags, F.coalesce(without if without is not None else F.lit(False), F.lit(False)).alias("_not"))
    any_step = F.col("_not")
    for k in range(len(steps)):
        any_step = any_step | F.col(f"_s{k}")
    rows = materialize(rows.where(any_step), "steps")
    order, keys = [F.col("_at")], tuple(by)
    swept = running_max(rows, order, {"_start": F.when(F.col("_s0"), F.col("_at")), "_broken": F.when(F.col("_not"), F.col("_at"))}, keys, one_task_rows)
    for k in range(1, len(steps)):
        alive = F.col("_start").isNotNull() & (F.col("_broken").isNull() | (F.col("_start") > F.col("_broken")))
        swept = swept.withColumn("_held", F.when(F.col(f"_s{k}") & alive, F.col("_start"))).drop("_start")
        if k < len(steps) - 1:
            swept = running_max(materialize(swept, "swept"), order, {"_start": F.col("_held")}, keys, one_task_rows).drop("_held")
    soon = F.col("_held.ts") + F.expr(f"interval {seconds} seconds") >= F.col("_at.ts")
    found = swept.where(F.col("_held").isNotNull() & soon)
    return found.select(*by, F.col("_held.tie").alias("first"), F.col("_at.tie").alias("last"), F.col("_held.ts").alias("first_ts"), F.col("_at.ts").alias("last_ts"))
