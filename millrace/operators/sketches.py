"""Sketches per group that are stored once and merged without their rows: distinct counts, set expressions, quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base-2 logarithms of the sizes of HLL and theta sketches; standard errors of 1.6% and 1.6%, for intersections of more,
#: by as much as the union is larger.
HLL_K = THETA_K = 12
#: A KLL sketch's rank error is about 1% of the rows, with 99% confidence.
KLL_K = 200


def sketched(df: DataFrame, by: list[Column], item: str, value: str) -> DataFrame:
    """A row for each group: hll and theta sketches of the distinct items and kll of the values, all partial before they
    are shuffled. Nulls are in none; a group of nulls only has empty sketches."""
    aggregates = [F.hll_sketch_agg(item, HLL_K).alias("hll"), F.theta_sketch_agg(item, THETA_K).alias("theta"), F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_K).alias("kll")]
    return df.groupBy(*by).agg(*aggregates)


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of larger groups from those of their parts, whose rows are not read again."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("hll").alias("hll"), F.theta_union_agg("theta", THETA_K).alias("theta"), F.kll_merge_agg_double("kll", KLL_K).alias("kll"))


def distinct(hll: Column | str) -> Column:
    return F.hll_sketch_estimate(hll)


def in_both(a: Column | str, b: Column | str) -> Column:
    """Distinct items in both of two theta sketches."""
    return F.theta_sketch_estimate(F.theta_intersection(a, b))


def in_first_only(a: Column | str, b: Column | str) -> Column:
    return F.theta_sketch_estimate(F.theta_difference(a, b))


def quantile(kll: Column | str, share: float) -> Column:
    """A value, so that about this share of all is at most as large."""
    return F.kll_sketch_get_quantile_double(kll, F.lit(share))
