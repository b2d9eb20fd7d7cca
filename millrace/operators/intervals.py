"""Intervals of time or numbers: which overlap, how many are open at a time, what they cover together.

A sweep turns intervals into events, one more open and one less, and sums them in order; the sums are carried over sorted
ranges, so that a key of very many intervals is in no one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.joins import range_join
from millrace.operators.prefix import ONE_TASK_ROWS, running_sums
from millrace.storage import materialize


def _sound(intervals: DataFrame, low: str, high: str) -> DataFrame:
    return intervals.where(F.col(low) < F.col(high))


def open_counts(intervals: DataFrame, low: str, high: str, by: list[str] | None = None, marks: DataFrame | None = None, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """(by, at, n_open) at each bound of the intervals [low, high), and at those of marks (by, at): how many of a key's
    intervals are open there, with all that begin there and none that end. Null bounds and empty and reversed intervals
    do not count; rows of a null key are one key. Rows stand for themselves."""
    by = by or []
    keys = [F.col(b) for b in by]
    sound = _sound(intervals, low, high)
    each = F.array(F.struct(F.col(low).alias("at"), F.lit(1).cast("long").alias("d")), F.struct(F.col(high).alias("at"), F.lit(-1).cast("long").alias("d")))
    events = sound.select(*keys, F.explode(each).alias("e")).select(*by, "e.*")
    if marks is not None:
        events = events.unionByName(marks.where(F.col("at").isNotNull()).select(*by, "at", F.lit(0).cast("long").alias("d")))
    # What happens at one time is one row before it is put in order.
    changed = materialize(events.groupBy(*by, "at").agg(F.sum("d").alias("d")), "changes")
    summed = running_sums(changed, [F.col("at")], {"_before": F.col("d")}, tuple(by), one_task_rows)
    return summed.select(*by, "at", (F.col("_before") + F.col("d")).alias("n_open"))


def most_open(intervals: DataFrame, low: str, high: str, unit: str = "hour", by: list[str] | None = None, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """(by, period, most_open) for each `unit` of time from a key's first interval to its last: the most that are open at
    one time in it. low and high are timestamps. A period in which none is open has 0."""
    by = by or []
    begin, step = F.date_trunc(unit, F.col("_low")), F.expr(f"interval 1 {unit}")
    spans = _sound(intervals, low, high).groupBy(*by).agg(F.min(low).alias("_low"), F.max(high).alias("_high"))
    marks = spans.select(*by, F.explode(F.sequence(begin, F.date_trunc(unit, F.col("_high")), step)).alias("at"))
    kind = intervals.schema[low].dataType
    counts = open_counts(intervals, low, high, by, marks.withColumn("at", F.col("at").cast(kind)), one_task_rows)
    return counts.groupBy(*by, F.date_trunc(unit, "at").cast(kind).alias("period")).agg(F.max("n_open").alias("most_open"))


def merged(intervals: DataFrame, low: str, high: str, by: list[str] | None = None, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """(by, low, high) of what the intervals of each key cover together; intervals that touch are one. Nulls and empty
    intervals are as in open_counts."""
    by = by or []
    counts = materialize(open_counts(intervals, low, high, by, None, one_task_rows), "counts")
    # Where none has been open before, one begins; where none is open, one ends: bounds come in turns.
    numbered = running_sums(counts, [F.col("at")], {"_closed": (F.col("n_open") == 0).cast("long")}, tuple(by), one_task_rows)
    of = numbered.groupBy(*by, "_closed").agg(F.min("at").alias(low), F.max("at").alias(high))
    return of.drop("_closed")


def overlapping(left: DataFrame, right: DataFrame, low: str, high: str, right_low: str, right_high: str, width: float, by: tuple[str, str] | None = None) -> DataFrame:
    """The inner join of left and right where [low, high) and [right_low, right_high), numbers, have a point in common:
    one of them begins in the other. By cells of `width` and twice, four times ... as wide, see range_join. by: a column
    of each side which must be equal too. The sides must have no column in common; null bounds and empty intervals
    overlap nothing. Rows stand for themselves."""
    l, r = _sound(left, low, high), _sound(right, right_low, right_high)  # noqa: E741
    within = range_join(l, r, low, right_low, right_high, width, by)
    contains = range_join(r, l, right_low, low, high, width, by and by[::-1]).where(F.col(right_low) > F.col(low))
    return within.unionByName(contains.select(*within.columns))
