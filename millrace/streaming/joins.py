"""Joins of two event streams by key and time, over streams and batches alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.streaming.windows import _timed


def _cell(ts: str, seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts) / seconds)


def join_within(left: DataFrame, right: DataFrame, by: tuple[str, str], ts: tuple[str, str], seconds: int, lateness: str = "1 hour", how: str = "left") -> DataFrame:
    """left joined to the right rows of the same key whose time is not before its own and at most so many seconds after.

    how: inner, or left, which keeps left rows without one. On streams both sides have a watermark of `lateness`, later
    rows are dropped, a row's state goes when no row to come can match it, and only then does a left row without a match
    come out. Rows meet by key and by cell of time, each right row in its own cell and the one before, so that neither
    state nor task holds all of a key. The sides must have no column in common. Rows without a key or a time match
    nothing; on a stream, left rows without a time never come out."""
    if how not in ("inner", "left"):
        raise ValueError(f"{how} is neither inner nor left")
    a = _timed(left, lateness, ts[0]).withColumn("_cell", _cell(ts[0], seconds))
    own = _cell(ts[1], seconds)
    b = _timed(right, lateness, ts[1]).withColumn("_cell_right", F.explode(F.array(own - 1, own)))
    soon = (F.col(ts[1]) >= F.col(ts[0])) & (F.col(ts[1]) <= F.col(ts[0]) + F.expr(f"interval {seconds} seconds"))
    same = (F.col(by[0]) == F.col(by[1])) & (F.col("_cell") == F.col("_cell_right"))
    return a.join(b, same & soon, how).drop("_cell", "_cell_right")
