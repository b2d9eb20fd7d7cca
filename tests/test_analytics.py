"""Searches, joins by order and sweeps: SQL, brute force, hot keys, nulls, ties, empty tables."""

import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import inequality, intervals, joins, neighbors, sessions
from millrace.plans import analytics
from tests import oracle


VECTORS = "vec_id long, embedding array<float>, label int"


def _nearest(rows, k):
    sound = [(i, np.array(v, float)) for i, v in rows if i is not None and v and any(v)]
    unit = [(i, v / np.linalg.norm(v)) for i, v in sound]
    out = {}
    for q, a in unit:
        near = sorted((-round(float(a @ b), 6), i) for i, b in unit if i != q)
        out[q] = [(i, -s) for s, i in near[:k]]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(200)]
    # A third of all are copies of one.
    rows += [(200 + i, rows[7][1]) for i in range(100)]
    return [*rows, (900, [0.0] * 8), (901, None), (None, rows[3][1]), (902, [])]


@pytest.mark.parametrize("block", [7, 2048])
def test_exact_search(spark, vectors, block, monkeypatch):
    monkeypatch.setattr(neighbors, "SLICE", 5)
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors], VECTORS).where("vec_id is null or vec_id < 902")
    index = neighbors.build_index(df, block=block)
    got = {}
    for r in neighbors.search(df, index, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.similarity))
    assert got == {q: [(i, pytest.approx(s, abs=2e-6)) for i, s in best] for q, best in _nearest(vectors, 4).items()}


def test_blocks_are_not_broadcast_and_queries_are_sent_once_to_a_group(spark, vectors, monkeypatch):
    monkeypatch.setattr(neighbors, "GROUPS", 3)
    monkeypatch.setattr(neighbors, "BLOCK", 40)
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors], VECTORS).where("vec_id < 902")
    index = neighbors.build_index(df, block=7)
    found = neighbors.search(df, index, 4)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.similarity))
    assert index.blocks.count() > 40 and got == {q: [(i, pytest.approx(s, abs=2e-6)) for i, s in best] for q, best in _nearest(vectors, 4).items()}
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # What is broadcast are the numbers of blocks.
    assert "SortMergeJoin" in plan and plan.count(" BroadcastExchange") == 2


def test_index_finds_nine_in_ten(spark):
    """Of the tables of the driver; their vectors lie in no clusters, so that most cells must be looked into."""
    for folder in ("sf0.001", "sf0.1"):
        sf_dir = oracle.SF_DIR.replace("sf0.001", folder)
        exact = {(r.query_id, r.id) for r in analytics.vector_neighbors(spark, sf_dir).collect()}
        found = {(r.query_id, r.id) for r in analytics.vector_neighbors_indexed(spark, sf_dir).collect()}
        assert len(exact & found) >= 0.9 * len(exact) and len(found) == len(exact)


def test_index_has_every_row_and_clusters_save_probes(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(20, 16))
    rows = [(i, (centers[i % 20] + 0.05 * rng.normal(size=16)).tolist(), 0) for i in range(1500)]
    df = spark.createDataFrame(rows, VECTORS)
    index = neighbors.build_index(df, 30, block=20)
    assert index.blocks.select(F.explode("of.id")).distinct().count() == 1500 and index.probes <= 5
    exact = {(r.query_id, r.id) for r in neighbors.search(df.where("vec_id < 50"), neighbors.build_index(df)).collect()}
    found = {(r.query_id, r.id) for r in neighbors.search(df.where("vec_id < 50"), index).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_search_of_nothing_and_of_odd_lengths(spark):
    none = spark.createDataFrame([], VECTORS)
    some = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 1.0], 0)], VECTORS)
    assert neighbors.search(some, neighbors.build_index(none)).count() == 0
    assert neighbors.search(none, neighbors.build_index(some, -1)).count() == 0
    assert [tuple(r) for r in neighbors.search(some.where("vec_id = 2"), neighbors.build_index(some)).orderBy("rank").collect()] == [(2, 1, 1, 0.707107), (2, 2, 1, 0.707107)]
    with pytest.raises(ValueError, match="dimensions"):
        neighbors.build_index(some.union(spark.createDataFrame([(3, [1.0], 0)], VECTORS)))
    named = some.withColumn("vec_id", F.concat(F.lit("v"), "vec_id"))
    assert neighbors.search(named.where("vec_id = 'v2'"), neighbors.build_index(named)).count() == 2


OPS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


@pytest.mark.parametrize(("first", "second", "keyed"), [("<", ">", False), (">=", ">=", True), ("<=", "<", False), (">", "<=", True)])
def test_inequalities_against_all_pairs(spark, first, second, keyed):
    rnd = random.Random(f"{first}{second}")
    # One value of x, and one key, is that of most rows.
    value = lambda: rnd.choice([None, 5, 5, 5, 5, 5, *range(10)])
    left = [(rnd.choice([None, "a", "a", "a", "b"]), value(), value(), i) for i in range(120)]
    right = [(rnd.choice([None, "a", "a", "a", "c"]), value(), value(), i) for i in range(140)]
    a, b = spark.createDataFrame(left, "k string, x int, y int, i int"), spark.createDataFrame(right, "k string, u int, `v.w` int, j int")
    holds = lambda p, q: None not in (p[1], p[2], q[1], q[2]) and OPS[first](p[1], q[1]) and OPS[second](p[2], q[2]) and (not keyed or p[0] == q[0] is not None)
    pairs = Counter((p[3], q[3]) for p in left for q in right if holds(p, q))
    by = ["k"] if keyed else None
    for few in (0, 100_000):
        args = (("x", first, "u"), ("y", second, "v.w"), by)
        got = inequality.inequality_counts(a, b, *args, "n", 4, few, few).collect()
        assert {r.i: r.n for r in got} == {p[3]: sum(n for (i, _), n in pairs.items() if i == p[3]) for p in left} and len(got) == len(left)
        found = inequality.inequality_join(a, b if keyed else b.drop("k"), *args, 4, few, few)
        assert Counter((r.i, r.j) for r in found.collect()) == pairs and found.columns == [*a.columns, "u", "v.w", "j"]


def test_counts_write_each_row_twice(spark, monkeypatch):
    written, write = [], inequality.materialize
    monkeypatch.setattr(inequality, "materialize", lambda df, name: written.append(write(df, name)) or written[-1])
    n = 2000
    df = spark.range(n).selectExpr("id", "pmod(xxhash64(id), 700) as x", "pmod(xxhash64(id, 1), 900) as y")
    got = {r.id: r.n for r in inequality.inequality_counts(df, df, ("x", "<", "x"), ("y", ">", "y"), None, "n", 500, 0, 0).collect()}
    ids, x, y = (np.array(c) for c in zip(*df.collect(), strict=True))
    assert got == dict(zip(ids.tolist(), ((x[:, None] < x) & (y[:, None] > y)).sum(axis=1).tolist(), strict=True))
    assert sum(w.count() for w in written) == 2 * 2 * n


def test_counts_with_more_partitions_than_asked_for(spark, monkeypatch):
    ordered = inequality._ordered
    monkeypatch.setattr(inequality, "_ordered", lambda df, order, chunks: ordered(df, order, 7))
    df = spark.range(100).selectExpr("id", "pmod(xxhash64(id), 30) as x", "pmod(xxhash64(id, 1), 40) as y", "id % 3 as k")
    rows = df.collect()
    for few in (0, 100_000):
        for by in (None, ["k"]):
            got = {r.id: r.n for r in inequality.inequality_counts(df, df, ("x", "<", "x"), ("y", ">", "y"), by, "n", 50, few).collect()}
            assert got == {a.id: sum(a.x < b.x and a.y > b.y and (by is None or a.k == b.k) for b in rows) for a in rows}


def test_inequalities_of_empty_sides(spark):
    a, none = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([], "u int, v int")
    assert [tuple(r) for r in inequality.inequality_counts(a, none, ("x", "<", "u"), ("y", "<", "v")).collect()] == [(1, 2, 0)]
    assert inequality.inequality_counts(none, a, ("u", "<", "x"), ("v", "<", "y")).count() == 0
    assert inequality.inequality_join(a, none, ("x", "<", "u"), ("y", "<", "v")).count() == 0
    with pytest.raises(ValueError, match="no inequality"):
        inequality.inequality_counts(a, none, ("x", "=", "u"), ("y", "<", "v"))


def test_a_large_theta_join_is_refused(spark):
    wide = spark.range(10).withColumn("t", F.lit("x" * 1000))
    with pytest.raises(ValueError, match="inequality_join"):
        joins.theta_join(spark.range(5), wide, F.lit(True), size=5_000)
    with pytest.raises(ValueError, match="inequality_join"):
        joins.theta_join(spark.range(5), wide, F.lit(True), rows=9)


SPANS = "k string, low int, high int, i int"


@pytest.fixture(scope="module")
def spans():
    rnd = random.Random(4)
    rows = []
    for i in range(400):
        low = rnd.choice([None, *range(60)])
        rows.append((rnd.choice([None, "hot", "hot", "hot", "b", "c"]), low, None if low is None else rnd.choice([None, low - 1, low, low + 1, low + 1, low + rnd.randint(1, 9)]), i))
    return rows


def _sound(rows):
    return [r for r in rows if r[1] is not None and r[2] is not None and r[1] < r[2]]


@pytest.mark.parametrize("one_task_rows", [0, 100_000])
def test_sweeps_against_every_point(spark, spans, one_task_rows):
    df = spark.createDataFrame(spans, SPANS)
    covered = {}
    for k, low, high, _ in _sound(spans):
        covered.setdefault(k, Counter()).update(range(low, high))
    counts = {(r.k, r.at): r.n_open for r in intervals.open_counts(df, "low", "high", ["k"], None, one_task_rows).collect()}
    assert counts == {(k, t): covered[k][t] for k in covered for r in _sound(spans) if r[0] == k for t in r[1:3]}
    whole = set()
    for k, points in covered.items():
        for t in points:
            if t - 1 not in points:
                end = t
                while end in points:
                    end += 1
                whole.add((k, t, end))
    got = [tuple(r) for r in intervals.merged(df, "low", "high", ["k"], one_task_rows).collect()]
    assert set(got) == whole and len(got) == len(whole)
    assert intervals.merged(df.limit(0), "low", "high", ["k"], one_task_rows).count() == 0


def test_most_open_counts_quiet_hours(spark):
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    rows = [("a", at(0, 10), at(3, 20)), ("a", at(0, 20), at(0, 30)), ("a", at(0, 30), at(0, 40)), ("a", at(5), at(6)), (None, at(1), at(1, 1)), ("a", None, at(1))]
    got = intervals.most_open(spark.createDataFrame(rows, "k string, low timestamp_ntz, high timestamp_ntz"), "low", "high", "hour", ["k"]).collect()
    assert {(r.k, r.period.hour): r.most_open for r in got} == {("a", 0): 2, ("a", 1): 1, ("a", 2): 1, ("a", 3): 1, ("a", 4): 0, ("a", 5): 1, ("a", 6): 0, (None, 1): 1}


def test_overlaps_against_all_pairs(spark, spans):
    a = spark.createDataFrame(spans, SPANS)
    b = a.where("i % 3 = 0").toDF("l", "from", "to", "j")
    for by in (None, ("k", "l")):
        got = Counter((r.i, r.j) for r in intervals.overlapping(a, b, "low", "high", "from", "to", 2.0, by).collect())
        assert got == Counter((p[3], q[3]) for p in _sound(spans) for q in _sound(spans) if q[3] % 3 == 0 and p[1] < q[2] and q[1] < p[2] and (by is None or p[0] == q[0] is not None))


@pytest.mark.parametrize("one_task_rows", [0, 100_000])
def test_sessions_of_a_hot_user(spark, one_task_rows):
    rnd = random.Random(6)
    start = datetime(2024, 1, 1)
    rows = [(rnd.choice([None, 1, 1, 1, 1, 2]), rnd.choice([None, *[start + timedelta(minutes=10 * rnd.randint(0, 400))] * 9]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "u int, ts timestamp_ntz, session_no int")
    got = {r.i: r.session_no for r in sessions.sessionize(df.withColumn("i", F.col("session_no")), "u", "ts", 1800, one_task_rows).collect()}
    expected = {i: 1 for _, t, i in rows if t is None}
    for u in {r[0] for r in rows}:
        last, no = None, 0
        for t, i in sorted((t, i) for v, t, i in rows if v == u and t is not None):
            no += last is None or t > last + timedelta(seconds=1800)
            last, expected[i] = t, no
    assert got == expected
