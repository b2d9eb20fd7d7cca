"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

The shard of a key follows from the key and the number of shards alone, without a table; with one shard more, a row
either stays or moves into the new shard, and only the share that balances them moves.

Rows are numbered within their shard by range-partitioning the narrow rows by key, counting by shard and partition,
and adding the counts before: no task ever holds a shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import extras_apart, materialize

SHARDS = 16
LAW = "key"
_STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, all keys at once: a key jumps ahead until it would leave the shards."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    state = keys.astype(np.int64).view(np.uint64).copy()
    at, ahead = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        at[live] = ahead[live]
        with np.errstate(over="ignore"):
            state[live] = state[live] * _STEP + np.uint64(1)
        draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[live] = ((at[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[ahead[live] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key that casts to bigint; a null key goes where key 0 goes."""

    @F.pandas_udf("int")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64), shards))

    return run(F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint")))


@extras_apart("id_col", "text_col")
def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without its text, with size, text_crc32, law, shard, slot and grown_shard (of one shard more).

    size is the text's UTF-8 bytes (null: none) plus 1, text_crc32 the unsigned CRC of the same bytes (null: of none).
    Within a shard, slots count from 0 without gaps in the order of id (null first), CRC and size; equal rows take
    their slots in any order. Rows with equal ids, of any type that Spark sorts and hashes, go to one shard; the law depends on nothing else. Other columns pass
    through; ones named as a result give way. An empty table gives an empty result.
    """
    results = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rest = [c for c in docs.columns if c != text_col and c.lower() not in results]
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    narrow = docs.select(*rest, (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    # Other ids than whole numbers jump by their hash.
    key = F.col(id_col) if isinstance(docs.schema[id_col].dataType, T.IntegralType) else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))
    narrow = materialize(narrow.select("*", F.lit(LAW).alias("law"), shard_of(key, shards).alias("shard"), shard_of(key, shards + 1).alias("grown_shard")), "narrow")
    order = [F.col(id_col).asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    # Equal rows are spread over partitions, too; the number of a row in its file would do as well.
    dealt = narrow.repartitionByRange(*order, F.xxhash64(F.monotonically_increasing_id()))
    dealt = materialize(dealt.withColumn("_part", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("shard", "_part").orderBy(*order)) - 1
    return dealt.withColumn("_k", within).join(offsets, ["shard", "_part"]).withColumn("slot", (F.col("_before") + F.col("_k")).cast("long")).select(*rest, *results)
