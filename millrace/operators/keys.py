"""Joins that know hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.storage import BROADCAST_ROWS, is_small, materialize

#: A key is hot in a join if it has so many rows, and one in HOT_SHARE of all.
HOT_ROWS, HOT_SHARE = 50_000, 10_000


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The inner join of left and right, whose rows have keys of their own; both are written tables, nulls join nothing.

    A small right side goes to all executors. Otherwise the hot keys do, of which there are at most HOT_SHARE, and the
    rows of the others are shuffled: no key's rows meet in one task.
    """
    if is_small(right, rows):
        return left.join(F.broadcast(right), keys)
    least = max(hot_rows, left.count() // HOT_SHARE)
    hot = left.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > least).select(*keys)
    met = F.broadcast(materialize(right.join(F.broadcast(materialize(hot, "hot")), keys, "left_semi"), "hot"))
    return left.join(met, keys).unionByName(left.join(met.select(*keys), keys, "left_anti").join(right, keys))
