"""Regular time series: gaps found by a spine of times, and filled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.prefix import ONE_TASK_ROWS, running_max
from millrace.storage import materialize


def gap_filled(points: DataFrame, by: list[str], at: str, value: str, unit: str = "hour", one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """(by, at, value, last_value, linear): for each key every `unit` of time from its first to its last one in points,
    with the mean of its values in it, null if it has none; the mean of the last unit that has one, itself included;
    and what lies on the line between the last and the next one that have.

    Rows with a null time are left out, null values and NaN do not count, but their time does. Neighbours are carried
    over sorted ranges, so no key is in one task. Rows of a null key are one series."""
    kind = points.schema[at].dataType
    begin = F.date_trunc(unit, F.col(at)).cast("timestamp")
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    means = points.where(F.col(at).isNotNull()).groupBy(*by, begin.alias("_t")).agg(F.avg(v).alias("_v"))
    means = materialize(means, "means")
    span = means.groupBy(*by).agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    spine = span.select(*by, F.explode(F.sequence("_first", "_last", F.expr(f"interval 1 {unit}"))).alias("_t"), F.lit(None).cast("double").alias("_v"))
    every = materialize(means.unionByName(spine).groupBy(*by, "_t").agg(F.max("_v").alias("_v")), "spine")
    # The last known one before, and by the times in reverse the next.
    seconds = F.col("_t").cast("double")
    known = lambda sign: F.when(F.col("_v").isNotNull(), F.struct((sign * seconds).alias("s"), F.col("_v").alias("v")))
    back = materialize(running_max(every, [F.col("_t")], {"_before": known(1)}, tuple(by), one_task_rows), "before")
    both = running_max(back, [F.col("_t").desc()], {"_after": known(-1)}, tuple(by), one_task_rows)
    share = (seconds - F.col("_before.s")) / (-F.col("_after.s") - F.col("_before.s"))
    line = F.col("_before.v") + (F.col("_after.v") - F.col("_before.v")) * share
    return both.select(*by, F.col("_t").cast(kind).alias("at"), F.col("_v").alias("value"), F.coalesce("_v", "_before.v").alias("last_value"), F.coalesce(F.col("_v"), line).alias("linear"))
