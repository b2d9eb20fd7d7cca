"""User-defined functions, for what the built-in ones lack: a scalar, an aggregate and a table function, all on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def entropy(text: pd.Series) -> pd.Series:
    """Bits per character of a text's own character frequencies; 0 for an empty one, null for null."""

    def of(t: str | None) -> float | None:
        if t is None:
            return None
        n = np.unique(list(t), return_counts=True)[1] if t else np.array([1])
        return float(abs(-(n / n.sum() * np.log2(n / n.sum())).sum()))

    return text.map(of)


@F.pandas_udf(T.DoubleType())
def _median_of_counts(value: pd.Series, n: pd.Series) -> float:
    order = np.argsort(value.to_numpy())
    v, upto = value.to_numpy()[order], n.to_numpy()[order].cumsum()
    total = upto[-1]
    at = lambda k: v[np.searchsorted(upto, k, side="right")]
    return float((at((total - 1) // 2) + at(total // 2)) / 2)


def median_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The exact median of a column of few distinct values, as `median`, by an aggregate function over distinct values
    with their counts: rows are counted before they are shuffled. Nulls do not count; a key of nulls only is left out."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_value")).agg(F.count("*").alias("_n"))
    return counted.groupBy(*keys).agg(_median_of_counts("_value", "_n").alias("median"))


@F.udtf(returnType=T.StructType([T.StructField("place", T.IntegerType()), T.StructField("word", T.StringType())]))
class Words:
    """The words of a text with their places, from 0; none for null."""

    def eval(self, text: str | None) -> Iterator[tuple[int, str]]:
        yield from enumerate((text or "").split())


def words_of(df: DataFrame, text: Column) -> DataFrame:
    """df with a row for each word of text, by a lateral join with the table function: place and word."""
    marked = df.withColumn("_text", text)
    return marked.lateralJoin(Words(F.col("_text").outer())).drop("_text")
