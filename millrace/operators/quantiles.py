"""Exact percentiles of columns of any number of values, by histograms that narrow.

Each pass counts, of the values between the bounds known so far, how many lie in each of BUCKETS parts, and keeps the
part that holds the rank looked for, its bounds being values that are there. So no group is sorted or held, and what is
shuffled is a row for each bucket and task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.storage import BROADCAST_ROWS, broadcast_if_small, materialize

BUCKETS, MAX_PASSES = 4096, 1100


def exact_percentiles(df: DataFrame, by: list[str], value: str, percents: list[float], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(by, percent, value) for each group and each of percents (0 to 1): interpolated between the two values next to its
    rank, as by percentile_cont. Nulls and NaN do not count, a group of nothing else has no rows; values must be finite.
    Rows of a null key are one group. Raises RuntimeError if MAX_PASSES do not find the values; two of every pass's
    buckets hold a bound, so that each pass leaves values out."""
    keys = [f"_k{k}" for k in range(len(by))]
    own = [F.col(b).alias(k) for b, k in zip(by, keys, strict=True)]
    plain = df.select(*own, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    groups = plain.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    asked = groups.withColumn("_p", F.explode(F.array(*[F.lit(float(p)) for p in percents]).cast("array<double>"))).withColumn("_r", F.col("_p") * (F.col("_n") - 1))
    asked = materialize(asked, "asked")
    ends = F.array_distinct(F.array(F.floor("_r"), F.ceil("_r")))
    open_ = materialize(asked.select(*keys, F.explode(ends).alias("_rank"), "_low", "_high").distinct().withColumn("_below", F.lit(0).cast("long")), "bounds")
    found: DataFrame | None = None
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of{k}"))
    for _ in range(MAX_PASSES):
        done = open_.where("_low = _high").select(*keys, "_rank", F.col("_low").alias("_value"))
        found = done if found is None else found.unionByName(done)
        open_ = open_.where("_low < _high")
        if open_.isEmpty():
            break
        named = open_.select(*[F.col(k).alias(f"_of{k}") for k in keys], "_rank", "_low", "_high", "_below")
        inside = plain.join(broadcast_if_small(named, broadcast_rows), same & (F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))
        share = (F.col("_v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2)
        # The upper bound is in a bucket that the lower one is not in, however near they are.
        bucket = F.when(F.col("_v") == F.col("_high"), BUCKETS - 1).otherwise(F.least(F.lit(BUCKETS - 2), F.floor(share * (BUCKETS - 1)))).cast("int")
        counted = inside.groupBy(*keys, "_rank", "_below", bucket.alias("_b")).agg(F.count("*").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        # At most BUCKETS rows of a rank.
        upto = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys, "_rank").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = counted.withColumn("_before", F.col("_below") + upto).where("_before <= _rank and _rank < _before + _c")
        open_ = materialize(placed.select(*keys, "_rank", "_low", "_high", F.col("_before").cast("long").alias("_below")), "bounds")
    else:
        raise RuntimeError(f"percentiles not found in {MAX_PASSES} passes")
    found = broadcast_if_small(materialize(found, "found"), broadcast_rows)
    of = lambda name: found.select(*[F.col(k).alias(f"_{name}{k}") for k in keys], F.col("_rank").alias(f"_{name}rank"), F.col("_value").alias(f"_{name}"))
    out = asked
    for name, rank in (("lower", F.floor("_r")), ("upper", F.ceil("_r"))):
        on = rank == F.col(f"_{name}rank")
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_{name}{k}"))
        out = out.join(of(name), on)
    exact = F.col("_lower") + (F.col("_upper") - F.col("_lower")) * (F.col("_r") - F.floor("_r"))
    return out.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], F.col("_p").alias("percent"), exact.alias("value"))
