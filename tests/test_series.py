"""Sequence patterns, exact percentiles, gap filling and stored sketches: brute force, hot keys, nulls, ties, empty tables."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import sequences, series, sketches
from millrace.operators.prefix import running_max
from millrace.operators.quantiles import exact_percentiles

START = datetime(2024, 1, 1)


@pytest.mark.parametrize("one_task_rows", [0, 100_000])
def test_running_max_by_key(spark, one_task_rows):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, 1, 1, 1, 2]), i, rnd.choice([None, rnd.randint(0, 99)])) for i in range(300)]
    got = {r.o: r.m for r in running_max(spark.createDataFrame(rows, "k int, o int, v int").repartition(5), [F.col("o")], {"m": F.col("v")}, ("k",), one_task_rows).collect()}
    for k, o, _ in rows:
        assert got[o] == max((v for k2, o2, v in rows if k2 == k and o2 < o and v is not None), default=None)


@pytest.mark.parametrize("one_task_rows", [0, 100_000])
def test_funnels_against_all_sequences(spark, one_task_rows):
    rnd = random.Random(2)
    rows = [(rnd.choice([None, 1, 1, 1, 1, 2]), rnd.choice([None, *[START + timedelta(minutes=rnd.randint(0, 200))] * 9]), rnd.choice([None, "a", "b", "c", "stop", "x", "ac"]), i) for i in range(260)]
    has = lambda x: F.col("kind").contains(x)
    df = spark.createDataFrame(rows, "u int, t timestamp_ntz, kind string, i int")
    for without in (None, F.col("kind") == "stop"):
        found = sequences.funnel(df, ["u"], "t", "i", [has("a"), has("b"), has("c")], 3600, without, one_task_rows)
        got = {(r.u, r.first, r["last"]) for r in found.collect()}
        expected = set()
        for u in (1, 2):
            own = sorted(((t, i), kind) for v, t, kind, i in rows if v == u and t is not None and kind is not None)
            for end, kind in own:
                if "c" not in kind:
                    continue
                best = None
                for start, first in own:
                    between = [(at, k) for at, k in own if start < at < end]
                    if start < end and "a" in first and end[0] - start[0] <= timedelta(hours=1) and any("b" in k for _, k in between) and (without is None or not any(k == "stop" for _, k in between)):
                        best = start
                if best:
                    expected.add((u, best[1], end[1]))
        assert got == expected and found.count() == len(expected) > 5
    assert sequences.funnel(df.limit(0), ["u"], "t", "i", [has("a"), has("b")], 60).count() == 0
    with pytest.raises(ValueError, match="two steps"):
        sequences.funnel(df, ["u"], "t", "i", [has("a")], 60)


def test_percentiles_against_numpy(spark):
    rnd = random.Random(3)
    values = {"hot": [rnd.choice([5.0, 5.0, rnd.gauss(0, 1), rnd.gauss(0, 1) * 1e-12, 1e300 * rnd.random(), -1e300 * rnd.random()]) for _ in range(800)], "one": [2.5], "two": [1.0, 2.0], None: [float(k) for k in range(57)], "same": [7.0] * 20}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("one", None), ("one", math.nan), ("none", None)]
    percents = [0.0, 0.013, 0.25, 0.5, 0.999, 1.0]
    df = spark.createDataFrame(rows, "k string, v double")
    for broadcast_rows in (0, 1000):
        got = {(r.k, r.percent): r.value for r in exact_percentiles(df, ["k"], "v", percents, broadcast_rows).collect()}
        assert len(got) == len(values) * len(percents)
        for k, vs in values.items():
            for p in percents:
                assert got[k, p] == pytest.approx(float(np.quantile(np.array(vs), p)), rel=1e-9, abs=1e-20), (k, p)
    assert exact_percentiles(df.limit(0), ["k"], "v", percents).count() == 0
    assert [tuple(r) for r in exact_percentiles(df.where("k = 'two'"), [], "v", [0.5]).collect()] == [(0.5, 1.5)]


@pytest.mark.parametrize("one_task_rows", [0, 100_000])
def test_gaps_are_filled_from_either_side(spark, one_task_rows):
    at = lambda h, m=0: START + timedelta(hours=h, minutes=m)
    rows = [("a", at(0, 5), 1.0), ("a", at(0, 50), 3.0), ("a", at(4), 10.0), ("a", at(2), None), ("a", at(7), math.nan), ("b", at(3), 5.0), (None, at(1), 1.0), (None, at(2), 2.0), ("a", None, 99.0)]
    got = {(r.k, r.at): (r.value, r.last_value, r.linear) for r in series.gap_filled(spark.createDataFrame(rows, "k string, t timestamp_ntz, v double"), ["k"], "t", "v", "hour", one_task_rows).collect()}
    none = (None, 10.0, None)
    assert got == {("a", at(0)): (2.0, 2.0, 2.0), ("a", at(1)): (None, 2.0, 4.0), ("a", at(2)): (None, 2.0, 6.0), ("a", at(3)): (None, 2.0, 8.0), ("a", at(4)): (10.0, 10.0, 10.0), ("a", at(5)): none, ("a", at(6)): none, ("a", at(7)): none, ("b", at(3)): (5.0, 5.0, 5.0), (None, at(1)): (1.0, 1.0, 1.0), (None, at(2)): (2.0, 2.0, 2.0)}
    assert series.gap_filled(spark.createDataFrame([], "k string, t timestamp_ntz, v double"), ["k"], "t", "v").count() == 0


def test_merged_sketches_are_near_the_exact_figures(spark):
    df = spark.range(40_000).select((F.col("id") % 10).alias("day"), (F.col("id") * 7919 % 13_000).alias("item"), (F.col("id") % 1000).cast("double").alias("v"))
    df = df.union(spark.createDataFrame([(3, None, None)] * 5 + [(77, None, None)], "day long, item long, v double"))
    daily = sketches.sketched(df, ["day"], "item", "v")
    for days in ([0], [1, 2, 3], list(range(10))):
        whole = sketches.merged(daily.where(F.col("day").isin(days)).withColumn("g", F.lit(1)), ["g"]).select(sketches.distinct("hll").alias("n"), *[sketches.quantile("kll", q).alias(f"q{k}") for k, q in enumerate((0.1, 0.5, 0.9))]).first()
        rows = df.where(F.col("day").isin(days) & F.col("v").isNotNull())
        exact = rows.select("item").distinct().count()
        assert abs(whole.n - exact) <= 0.06 * exact
        for k, q in enumerate((0.1, 0.5, 0.9)):
            assert abs(rows.where(F.col("v") <= whole[f"q{k}"]).count() / rows.count() - q) <= 0.03
    sets = daily.where("day = 1").select(F.col("theta").alias("a")).crossJoin(F.broadcast(daily.where("day = 2").select(F.col("theta").alias("b"))))
    got = sets.select(sketches.in_both("a", "b").alias("both"), sketches.in_first_only("a", "b").alias("only")).first()
    one, two = ({r.item for r in df.where(F.col("day") == d).select("item").distinct().collect()} for d in (1, 2))
    assert abs(got.both - len(one & two)) <= 0.06 * len(one | two) and abs(got.only - len(one - two)) <= 0.06 * len(one | two)
    assert daily.where("day = 77").select(sketches.distinct("hll").alias("n")).first().n == 0
    assert sketches.merged(daily.limit(0), ["day"]).count() == 0
