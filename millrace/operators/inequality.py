"""Joins on two inequalities, both sides of any size.

Counts: rows of both sides are sorted by the second inequality, which numbers them, then cut into chunks by the first. A
right row before a left one in both orders is either in the left one's chunk, where they are compared; or in an earlier
chunk and in the same range of numbers, where they are compared as well; or in both an earlier chunk and an earlier range,
and is counted by a table of chunks and ranges. Each row is sent three times, whatever the number of rows.

Pairs: the first inequality turns into places: in its order, the right rows that a left row may meet are those before a bound.
Blocks of places, and pairs, fours and so on of blocks, are nodes of a binary tree; the places before a bound are at
most one node of each level and the beginning of a block. Within a node the second inequality does the same: the right
rows that match are those before a bound in its order. Both bounds come from prefix sums over sorted ranges, so no key,
node or value is held by one task, and what is read grows as n log n of the largest key, and with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.keys import join_unique
from millrace.operators.prefix import ONE_TASK_ROWS, running_sums
from millrace.storage import BROADCAST_ROWS, materialize

#: Right rows of a block.
BLOCK = 64
#: Rows of a chunk, about, and how many chunks there are at most: beyond, they have more rows.
CHUNK, MOST_CHUNKS = 100_000, 512
Inequality = tuple[str, str, str]


def _order(value: str, op: str, side: Column) -> list[Column]:
    """In this order, the right rows (side 1) that satisfy `left op right` stand before the left row (side 0)."""
    if op not in ("<", "<=", ">", ">="):
        raise ValueError(f"{op} is no inequality")
    return [F.col(value).asc() if op[0] == ">" else F.col(value).desc(), side if len(op) == 1 else -side]


def _both(left: DataFrame, right: DataFrame, first: Inequality, second: Inequality, by: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Left and right rows without nulls in what is compared: keys, _x, _y, _side (0 and 1) and _row, their own columns as
    c0, c1 ... in a struct; and the inner names of keys."""
    keys = [f"_by{k}" for k in range(len(by))]
    known = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()

    def narrow(df: DataFrame, side: int) -> DataFrame:
        x, y = (F.col(f"`{i[2 * side]}`") for i in (first, second))
        own = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(df.columns)])
        return df.select(*[F.col(f"`{b}`").alias(k) for b, k in zip(by, keys, strict=True)], x.alias("_x"), y.alias("_y"), F.lit(side).alias("_side"), own.alias("_row")).where(known)

    return narrow(left, 0), narrow(right, 1), keys


def _sides(left: DataFrame, right: DataFrame, first: Inequality, second: Inequality, by: list[str], one_task_rows: int) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
    """Left rows with _bound, how many right rows of their keys the first inequality admits, and right rows with _place in
    its order; both with _y and their own columns as c0, c1 ... in a struct; and the names of keys, inner and given."""
    lefts, rights, keys = _both(left, right, first, second, by)
    cast = lambda df, kind: df.select(*[c for c in df.columns if c != "_row"], (F.col("_row") if kind == "_left" else F.lit(None).cast(lefts.schema["_row"].dataType)).alias("_left"), (F.col("_row") if kind == "_right" else F.lit(None).cast(rights.schema["_row"].dataType)).alias("_right"))
    both = cast(lefts, "_left").unionByName(cast(rights, "_right"))
    side = F.col("_side")
    placed = running_sums(both, _order("_x", first[1], side), {"_place": side.cast("long"), "_id": (1 - side).cast("long")}, tuple(keys), one_task_rows)
    placed = materialize(placed, "placed")
    lefts = placed.where("_side = 0").select(*keys, "_y", F.col("_place").alias("_bound"), "_id", F.col("_left").alias("_row"))
    return lefts, placed.where("_side = 1").select(*keys, "_y", "_place", F.col("_right").alias("_row")), keys, by


def _nodes(lefts: DataFrame, rights: DataFrame, keys: list[str], op: str, block: int, one_task_rows: int) -> DataFrame:
    """Left and right rows (_side 0 and 1) at the nodes they meet in, with _before: how many of the node's right rows stand
    before them in the second inequality's order; of a left row, those that match."""
    top = lefts.agg(F.max("_bound")).first()[0] or 0
    levels = F.sequence(F.lit(0), F.lit(max(0, (top // block).bit_length() - 1)))
    at = lambda c, s: F.call_function("shiftright", c, s)
    q, b = F.floor(F.col("_bound") / block), F.floor(F.col("_place") / block)
    # A bound never ends with an odd node: nobody asks for it.
    mine = F.transform(F.filter(levels, lambda s: at(q, s) % 2 == 1), lambda s: F.struct(s.alias("level"), (at(q, s) - 1).alias("node")))
    theirs = F.transform(F.filter(levels, lambda s: (at(b, s) % 2 == 0) & (((at(b, s) + 1) * F.call_function("shiftleft", F.lit(1).cast("long"), s)) <= top // block)), lambda s: F.struct(s.alias("level"), at(b, s).alias("node")))
    none = lambda of: F.lit(None).cast(of.schema["_row"].dataType)
    left = lefts.select(*keys, "_y", F.lit(0).alias("_side"), "_id", F.explode(mine).alias("_at"), F.col("_row").alias("_left"), none(rights).alias("_right"))
    right = rights.select(*keys, "_y", F.lit(1).alias("_side"), F.col("_place").alias("_id"), F.explode(theirs).alias("_at"), none(lefts).alias("_left"), F.col("_row").alias("_right"))
    both = materialize(left.unionByName(right).select("*", F.col("_at.level").alias("_level"), F.col("_at.node").alias("_node")).drop("_at"), "nodes")
    return running_sums(both, _order("_y", op, F.col("_side")), {"_before": F.col("_side").cast("long")}, (*keys, "_level", "_node"), one_task_rows)


def _beginnings(lefts: DataFrame, rights: DataFrame, keys: list[str], op: str, block: int, broadcast_rows: int) -> DataFrame:
    """Left rows with _of, the right rows that match them in the block in which their bound lies."""
    blocks = rights.groupBy(*keys, F.floor(F.col("_place") / block).alias("_block")).agg(F.collect_list(F.struct("_place", "_y", "_row")).alias("_in"))
    begun = materialize(lefts.withColumn("_block", F.floor(F.col("_bound") / block)).where(F.col("_bound") % block > 0), "bounds")
    met = join_unique(begun, materialize(blocks, "blocks"), [*keys, "_block"], broadcast_rows)
    matches = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[op]
    return met.withColumn("_of", F.filter("_in", lambda r: (r["_place"] < F.col("_bound")) & matches(F.col("_y"), r["_y"]))).drop("_in")


def _lesser_before(right: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each row, how many right rows stand before it and have a lesser value.

    From the order of values, places are dealt bit by bit to the halves of ever smaller spans, each staying in the order
    of values; a row of an upper half counts the right rows of the lower half that it has passed."""
    n, every = np.zeros(len(value), np.int64), np.arange(len(value))
    at = np.lexsort((right, value))
    for bit in reversed(range(max(0, len(value) - 1).bit_length())):
        start, upper = every >> (bit + 1) << (bit + 1), (at >> bit) & 1 == 1
        passed = np.concatenate([[0], np.cumsum(right[at] & ~upper)])
        n[at[upper]] += (passed[every] - passed[start])[upper]
        uppers = np.concatenate([[0], np.cumsum(upper)])
        before = uppers[every] - uppers[start]
        dealt = np.empty_like(at)
        dealt[np.where(upper, start + (1 << bit) + before, every - before)] = at
        at = dealt
    return n


def _ordered(df: DataFrame, order: list[Column], chunks: int) -> DataFrame:
    """df in order, over so many partitions; equal rows are spread."""
    return df.repartitionByRange(chunks, *order, F.xxhash64(F.monotonically_increasing_id())).sortWithinPartitions(*order)


def _within_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_chunk, _key, _side, _number, _row) of a chunk, in its order, with _n, the right rows of the chunk that match,
    and whether they are of its first and of its last key."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    key, side, number = (np.concatenate([b.column(c).to_numpy() for b in batches]) for c in (1, 2, 3))
    right, every = side == 1, np.arange(len(key))
    begin = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), every, 0))
    # Lower keys come first in both orders: their right rows are all counted, and do not match.
    n = np.where(right, 0, _lesser_before(right, number) - np.concatenate([[0], np.cumsum(right)])[begin])
    firsts, lasts = begin == 0, begin == begin[-1]
    at = 0
    for b in batches:
        own = slice(at, at + b.num_rows)
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x[own]) for x in (n, firsts, lasts))], names=[*b.schema.names, "_n", "_first", "_last"])
        at += b.num_rows


def _lower_keys(counted: DataFrame) -> dict[int, int]:
    """For each chunk, at most MOST_CHUNKS, how many right rows of the chunks before have lower keys than its first one."""
    side = F.col("_side").cast("long")
    of = counted.groupBy("_chunk").agg(F.sum(side).alias("all"), F.max(F.when(F.col("_first"), F.col("_key"))).alias("first"), F.max(F.when(F.col("_last"), F.col("_key"))).alias("last"), F.sum(F.when(F.col("_last"), side)).alias("of_last"))
    out, total, key, of_key = {}, 0, None, 0
    for c in of.orderBy("_chunk").collect():
        same = of_key if c["first"] == key else 0
        out[c["_chunk"]] = total - same
        of_key = c["of_last"] + (same if c["first"] == c["last"] else 0)
        total, key = total + c["all"], c["last"]
    return out


def inequality_counts(
    left: DataFrame,
    right: DataFrame,
    first: Inequality,
    second: Inequality,
    by: list[str] | None = None,
    name: str = "n",
    block: int = CHUNK,
    one_task_rows: int = ONE_TASK_ROWS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """left with `name`, for how many right rows both inequalities (left column, <, <=, > or >=, right column) hold and the
    columns `by`, which both sides have, are equal. No pair is made. A null in any of these columns matches nothing. Rows
    stand for themselves. NaN is above all numbers. A left column called `name` gives way.

    block: rows of a chunk, about. one_task_rows: so many rows of both sides are one chunk. broadcast_rows is there as for
    inequality_join; nothing is broadcast."""
    left, side = left.drop(name), F.col("_side")
    by_first, by_second = (_order(c, i[1], side) for c, i in (("_x", first), ("_y", second)))
    lefts, rights, keys = _both(left, right, first, second, by or [])
    both = lefts.unionByName(rights.withColumn("_row", F.lit(None).cast(lefts.schema["_row"].dataType)))
    n = both.count()
    wanted = 1 if n <= one_task_rows else max(2, min(MOST_CHUNKS, -(-n // block)))
    # Keys come first in either order, so that rows of lower keys are before a row in both.
    numbered = _ordered(both, [*map(F.col, keys), *by_second], wanted).withColumn("_number", F.monotonically_increasing_id())
    dealt = _ordered(materialize(numbered.drop("_y"), "numbered"), [*map(F.col, keys), *by_first], wanted)
    dealt = dealt.select(F.spark_partition_id().alias("_chunk"), (F.xxhash64(*keys) if keys else F.lit(0).cast("long")).alias("_key"), "_side", "_number", "_row")
    schema = T.StructType([*dealt.schema.fields, T.StructField("_n", T.LongType()), T.StructField("_first", T.BooleanType()), T.StructField("_last", T.BooleanType())])
    counted = materialize(dealt.mapInArrow(_within_chunks, schema), "counted")
    lower = _lower_keys(counted) if keys else {}
    # A number's upper bits are the partition it was given in.
    ranged = counted.select(F.call_function("shiftright", "_number", F.lit(33)).cast("int").alias("_range"), "_chunk", "_side", "_number", "_n", "_first", "_row")
    # As many as there are, whatever was asked for.
    chunks, ranges = ((x or 0) + 1 for x in ranged.agg(F.max("_chunk"), F.max("_range")).first())
    every = lambda c, k: left.sparkSession.range(k).select(F.col("id").cast("int").alias(c))
    cells = every("_chunk", chunks).crossJoin(every("_range", ranges)).join(ranged.where("_side = 1").groupBy("_chunk", "_range").agg(F.count("*").alias("_c")), ["_chunk", "_range"], "left")
    # A row of a chunk for each range.
    under = F.sum("_c").over(Window.partitionBy("_chunk").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("_range", "_chunk", F.lit(2).alias("_side"), F.lit(0).cast("long").alias("_number"), under.alias("_n")).where("_n > 0")

    def across(rows: pa.Table) -> pa.Table:
        chunk, side, number, n = (rows.column(c).to_numpy() for c in ("_chunk", "_side", "_number", "_n"))
        under = np.zeros(chunks + 1, np.int64)
        under[chunk[side == 2] + 1] = n[side == 2]
        own = np.flatnonzero(side != 2)
        own = own[np.argsort(number[own])]
        total = n.copy()
        total[own] += _lesser_before(side[own] == 1, chunk[own]) + np.cumsum(under)[chunk[own]] - np.array([lower.get(c, 0) for c in range(chunks)])[chunk[own]]
        return pa.table({"_n": total, "_row": rows.column("_row")}).filter(pa.array(side == 0))

    if chunks > 1:
        # Left rows whose key begins in their chunk have no match in others.
        open_ = ranged.where("_side = 1 or _first").drop("_first").unionByName(cells, allowMissingColumns=True)
        summed = open_.groupBy("_range").applyInArrow(across, T.StructType().add("_n", T.LongType()).add("_row", counted.schema["_row"].dataType))
        summed = summed.unionByName(ranged.where("_side = 0 and not _first").select("_n", "_row"))
    else:
        summed = ranged.where("_side = 0").select("_n", "_row")
    out = summed.select(*[F.col("_row")[f"c{k}"].alias(c) for k, c in enumerate(left.columns)], F.col("_n").alias(name))
    unknown = F.lit(False)
    for c in [first[0], second[0], *(by or [])]:
        unknown = unknown | F.col(f"`{c}`").isNull()
    return out.unionByName(left.where(unknown).withColumn(name, F.lit(0).cast("long")))


def inequality_join(
    left: DataFrame,
    right: DataFrame,
    first: Inequality,
    second: Inequality,
    by: list[str] | None = None,
    block: int = BLOCK,
    one_task_rows: int = ONE_TASK_ROWS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """The inner join of left and right, as inequality_counts counts it: the columns of left, then those of right without
    `by`, which must have no name in common. Only rows that match are paired, a block of right rows at a time."""
    lefts, rights, keys, by = _sides(left, right, first, second, by or [], one_task_rows)
    nodes = materialize(_nodes(lefts, rights, keys, second[1], block, one_task_rows), "bounds")
    at = [*keys, "_level", "_node", "_block"]
    blocks = nodes.where("_side = 1").groupBy(*keys, "_level", "_node", F.floor(F.col("_before") / block).alias("_block")).agg(F.collect_list(F.struct(F.col("_before").alias("_place"), F.col("_right").alias("_row"))).alias("_in"))
    wanted = nodes.where("_side = 0 and _before > 0").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_before") - 1) / block))))
    met = join_unique(materialize(wanted.select(*at, "_before", F.col("_left").alias("_l")), "wanted"), materialize(blocks, "blocks"), at, broadcast_rows)
    full = met.select("_l", F.explode(F.filter("_in", lambda r: r["_place"] < F.col("_before"))).alias("_r")).select("_l", "_r._row")
    begun = _beginnings(lefts, rights, keys, second[1], block, broadcast_rows).select(F.col("_row").alias("_l"), F.explode("_of").alias("_r")).select("_l", "_r._row")
    both = full.unionByName(begun)
    mine = [F.col("_l")[f"c{k}"].alias(c) for k, c in enumerate(left.columns)]
    return both.select(*mine, *[F.col("_row")[f"c{k}"].alias(c) for k, c in enumerate(right.columns) if c not in by])
