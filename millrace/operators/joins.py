"""Joins that Spark's SQL has no syntax for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.storage import BROADCAST_BYTES, is_small

#: Levels of cells in a range join; an interval too wide for the last, or without an end, is in one cell of its own level.
LEVELS = 40


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], cell: Callable[[Column], Column] | None = None, suffix: str = "_right") -> DataFrame:
    """left with `values` of the last right row of the same `by` whose `on` is not after its own; null without one.

    Both sides are sorted together once per key and the last right row is carried forward: one shuffle, no pairs. A key
    with very many rows is split where `cell` is given, a non-decreasing function of `on` such as a date: rows are then
    swept by key and cell, and each cell begins with the last right row of the cells before, one row per key and cell.

    Among right rows with equal `by` and `on`, the one with the largest values counts. Rows with a null in `by` are
    one key; a null `on` is before all others. A value whose name the left side has gets `suffix`. Left columns keep
    their names, whatever they are.
    """
    key = [F.col(f"_by{k}") for k in range(len(by))]
    in_cell = cell if cell else lambda c: F.lit(0)
    held = F.struct(*[F.col(f"`{v}`").alias(f"v{k}") for k, v in enumerate(values)])
    named = lambda df: [*[F.col(f"`{b}`").alias(f"_by{k}") for k, b in enumerate(by)], F.col(f"`{on}`").alias("_on")]  # noqa: E731, ARG005
    marks = right.select(*named(right), held.alias("_held"))
    rows = left.select(*named(left), F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(left.columns)]).alias("_row"))
    nothing, no_row = F.lit(None).cast(marks.schema["_held"].dataType).alias("_held"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row")
    both = rows.select(*key, "_on", F.lit(1).alias("_side"), nothing, "_row").union(marks.select(*key, "_on", F.lit(0).alias("_side"), "_held", no_row)).withColumn("_cell", in_cell(F.col("_on")))
    if cell:
        latest = both.groupBy(*key, "_cell").agg(F.max(F.when(F.col("_side") == 0, F.struct("_on", "_held"))).alias("m"))
        before = F.last("m", ignorenulls=True).over(Window.partitionBy(*key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
        opening = latest.withColumn("m", before).where("m is not null")
        both = both.unionByName(opening.select(*key, F.lit(None).cast(both.schema["_on"].dataType).alias("_on"), F.lit(-1).alias("_side"), F.col("m._held").alias("_held"), no_row, "_cell"))
    first = F.when(F.col("_side") == -1, 0).otherwise(1)
    order = Window.partitionBy(*key, "_cell").orderBy(first, F.col("_on").asc_nulls_first(), "_side", "_held").rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumn("_last", F.last("_held", ignorenulls=True).over(order)).where("_side = 1")
    taken = {c.lower() for c in left.columns}
    return swept.select(
        *[F.col("_row")[f"c{k}"].alias(c) for k, c in enumerate(left.columns)],
        *[F.col("_last")[f"v{k}"].alias(v + suffix if v.lower() in taken else v) for k, v in enumerate(values)],
    )


def range_join(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, width: float, by: tuple[str, str] | None = None) -> DataFrame:
    """points joined to the intervals [low, high) that hold their `at`: an equi-join on cells, then a filter.

    Cells double in width from level to level, beginning with `width`, and an interval is in the level at which it
    touches at most two; a point is in one cell of each level that some interval has, LEVELS at most. So neither wide
    intervals nor ones without an end are repeated. Rows with a null bound or point join nothing; empty and reversed
    intervals hold no point. by: a column of each side which must be equal too. The sides must have no column in common.
    """
    spread = intervals.where(F.col(low) < F.col(high)).withColumn("_level", F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.coalesce(F.ceil(F.log2((F.col(high) - F.col(low)) / width)), F.lit(LEVELS)))).cast("int"))
    # At the last level all is one cell.
    cell = lambda c: F.when(F.col("_level") == LEVELS, 0).otherwise(F.floor(c / (F.lit(float(width)) * F.pow(F.lit(2.0), F.col("_level"))))).cast("long")
    spread = spread.withColumn("_cell", F.explode(F.array_distinct(F.array(cell(F.col(low)), cell(F.col(high))))))
    levels = [r[0] for r in spread.select("_level").distinct().collect()]
    placed = points.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>"))).withColumn("_cell", cell(F.col(at)))
    held: Column = (F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))
    if by:
        held = held & (F.col(by[0]) == F.col(by[1]))
    return placed.join(spread, ["_level", "_cell"]).where(held).drop("_level", "_cell")


def theta_join(left: DataFrame, right: DataFrame, on: Column, how: str = "inner", rows: int = 10_000, size: int = BROADCAST_BYTES) -> DataFrame:
    """left joined to right by any condition. A right side of at most so many rows and bytes goes to all executors, so that
    left is read once where it is. A larger one is refused rather than paired with all rows: for one or two inequalities
    there is inequality_join, for intervals range_join and overlapping, all of which take sides of any size."""
    if not is_small(right, rows, size):
        raise ValueError(f"the right side has more than {rows} rows or {size} bytes; use inequality_join, range_join or an equality")
    return left.join(F.broadcast(right), on, how)
