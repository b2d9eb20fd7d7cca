"""Prefix sums within keys of any size: what joins by order, sweeps and sessions are made of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.storage import materialize

#: So many rows may be put in order by a plain window, a key in a task.
ONE_TASK_ROWS = 100_000


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], by: tuple[str, ...] = (), one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """df with, for each name in sums, the sum of its expression over the rows before, within `by`; 0 for the first.

    Rows are sorted by ranges of (by, order), equal ones spread over ranges; each range is summed on its own and takes
    up what the ranges before have of the key it begins with, one row per range. No task holds a key. Rows equal in
    `order` come in any order. df is a written table, or cheap to count: one of few rows is summed by a plain window.
    Expressions must give whole numbers, none null.
    """
    plus = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return _running(df, order, sums, by, one_task_rows, F.sum, plus)


def running_max(df: DataFrame, order: list[Column], values: dict[str, Column], by: tuple[str, ...] = (), one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """df with, for each name in values, the largest of its expression (of any orderable type, nulls passed over) over the
    rows before, within `by`; null where there is none. Done as running_sums is: of expressions that grow with `order`,
    this is the last value before."""
    return _running(df, order, values, by, one_task_rows, F.max, lambda a, b: F.when(a.isNull() | (b > a), b).otherwise(a))


def _running(df: DataFrame, order: list[Column], values: dict[str, Column], by: tuple[str, ...], one_task_rows: int, of: Callable[[str | Column], Column], merged: Callable[[Column, Column], Column]) -> DataFrame:
    names = list(values)
    if df.count() <= one_task_rows:
        above = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({n: merged(of(e).over(above), F.lit(None)) for n, e in values.items()})
    own = [F.col(b).asc_nulls_first() for b in by]
    spread = F.xxhash64(F.monotonically_increasing_id())
    dealt = materialize(df.withColumns({f"_add_{n}": e for n, e in values.items()}).repartitionByRange(*own, *order, spread).withColumn("_range", F.spark_partition_id()), "ranges")
    key = F.struct(*by) if by else F.lit(0)
    totals = dealt.groupBy(key.alias("_of_key"), F.col("_range").alias("_of_range")).agg(*[of(f"_add_{n}").alias(f"_add_{n}") for n in names])
    # A range takes up what was before only for its first key, which is the last of the range before.
    ends = totals.groupBy("_of_range").agg(F.min("_of_key").alias("_first"), F.max("_of_key").alias("_last"))
    carried = totals.join(F.broadcast(ends), "_of_range").where("_of_key <=> _first or _of_key <=> _last")
    before = Window.partitionBy("_of_key").orderBy("_of_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select("_of_key", "_of_range", *[of(f"_add_{n}").over(before).alias(f"_before_{n}") for n in names])
    within = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumns({n: of(f"_add_{n}").over(within) for n in names}).withColumn("_key_", key)
    met = F.broadcast(materialize(carried, "carried"))
    joined = summed.join(met, (F.col("_range") == F.col("_of_range")) & F.col("_key_").eqNullSafe(F.col("_of_key")), "left")
    return joined.select(*df.columns, *[merged(F.col(n), F.col(f"_before_{n}")).alias(n) for n in names])
