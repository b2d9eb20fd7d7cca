import datetime as dt
import random
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from millrace.functions import udfs
from millrace.operators import joins
from millrace.operators.sessions import sessionize
from millrace.plans import registry
from millrace.sources import tables
from millrace.streaming import state, windows
from tests import oracle


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_duckdb(spark, name):
    assert oracle.check(spark, registry.QUERIES[name], registry.ORACLE_SQL[name]) > 0


def test_distinct_counts_hold_no_sketch_for_each_pair(spark, tmp_path):
    rows = [(f, p) for f in ("A", "N", None) for p in (1, 1, 2, None)] + [("R", None)]
    spark.createDataFrame(rows, "l_returnflag string, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = registry.QUERIES["approximate_distinct"](spark, str(tmp_path))
    assert {tuple(r) for r in df.collect()} == {("A", 2, True), ("N", 2, True), (None, 2, True), ("R", 0, True)}
    keys = [line.split("keys=[")[1].split("]")[0] for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Aggregate(keys" in line and "approx_count_distinct" in line]
    assert keys and not any("l_partkey" in k for k in keys)


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_entry_without_the_subpackage_or_a_library_of_it(monkeypatch):
    whole = set(__spark_entry__.queries())
    for absent in ("millrace.llm.registry", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, absent, None)  # its import now fails
        left = set(__spark_entry__.queries())
        assert set(registry.QUERIES) <= left <= whole and "pipeline" not in left and set(__spark_entry__.oracle_sql()) <= left


def test_asof_join_takes_the_last_row_not_after(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), (None, 5), ("b", 3)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 1), ("a", 5, 2), ("a", 5, 3), (None, 4, 9)], "k string, t int, v int")
    got = {(r.k, r.t): r.v for r in joins.asof_join(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {("a", 1): None, ("a", 5): 3, (None, 5): 9, ("b", 3): None}


@pytest.mark.parametrize("cell", [None, lambda t: F.floor(t / 10)])
def test_asof_join_against_brute_force(spark, cell):
    """With a hot key, ties, nulls and names that both sides or the operator itself use."""
    rng = random.Random(1)
    key = lambda: rng.choice(["hot", "hot", "b", None])
    left = [(k, key(), rng.choice([None, *range(60)]), k) for k in range(200)]
    right = [(key(), rng.choice([None, *range(60)]), rng.choice([None, *range(9)])) for _ in range(150)]
    out = joins.asof_join(spark.createDataFrame(left, "_side int, k string, t int, v int"), spark.createDataFrame(right, "k string, t int, v int"), ["k"], "t", ["v"], cell=cell)
    assert out.columns == ["_side", "k", "t", "v", "v_right"]
    least = lambda x: -1 if x is None else x
    for i, k, t, v, found in out.collect():
        fits = [(least(b), least(c)) for a, b, c in right if a == k and least(b) <= least(t)]
        assert v == i and least(found) == max(fits, default=(0, -1))[1], (k, t)


def test_range_join_edges(spark):
    points = spark.createDataFrame([(0.0,), (1.0,), (2.5,), (None,)], "x double")
    spans = spark.createDataFrame([(1, 0.0, 1.0), (2, 0.5, 9.0), (3, 2.0, 2.0), (4, None, 3.0)], "i int, low double, high double")
    assert sorted((r.x, r.i) for r in joins.range_join(points, spans, "x", "low", "high", 1.0).collect()) == [(0.0, 1), (1.0, 2), (2.5, 2)]
    assert joins.range_join(points, spans.limit(0), "x", "low", "high", 1.0).count() == 0


def test_range_join_against_all_pairs(spark):
    rng = random.Random(2)
    xs = [rng.uniform(-50, 50) for _ in range(200)] + [0.0, 4.0, 1e300, -1e12, float("inf")]
    spans = [(k, lo, lo + rng.choice([0.1, 1, 3, 64, 1e6])) for k, lo in enumerate(rng.uniform(-60, 60) for _ in range(60))]
    spans += [(90, 0.0, 5e9), (91, 0.0, float("inf")), (92, float("-inf"), float("inf")), (93, 5.0, 1.0), (94, -8.0, 8.0)]
    got = joins.range_join(spark.createDataFrame([(x,) for x in xs], "x double"), spark.createDataFrame(spans, "i int, low double, high double"), "x", "low", "high", 1.0)
    assert sorted(map(tuple, got.select("x", "i").collect())) == sorted((x, i) for x in xs for i, lo, hi in spans if lo <= x < hi)


def test_theta_join_refuses_large_sides(spark):
    left, right = spark.range(5).toDF("a"), spark.range(4).toDF("b")
    assert joins.theta_join(left, right, F.col("a") > F.col("b"), "left").count() == 11
    with pytest.raises(ValueError, match="more than 3 rows"):
        joins.theta_join(left, right, F.col("a") > F.col("b"), rows=3)


def test_sessions_with_null_times(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    events = spark.createDataFrame([("a", None), ("a", None), ("a", t(1)), ("a", t(2)), ("a", t(9)), ("b", t(1)), (None, t(1)), (None, t(8))], "k string, ts timestamp_ntz")
    got = sorted(map(str, sessionize(events, "k", "ts", 3600).select("k", "session_no").collect()))
    assert got == sorted(f"Row(k={k!r}, session_no={n})" for k, n in [("a", 1)] * 4 + [("a", 2), ("b", 1), (None, 1), (None, 2)])
    assert sessionize(events.limit(0), "k", "ts", 3600).count() == 0


def test_tables_of_all_formats(spark, tmp_path):
    rows = [(1, "a,b", 1.5), (2, 'q"x', None), (3, None, -2.0)]
    df = spark.createDataFrame(rows, "id int, name string, x double")
    for fmt in ("parquet", "orc", "json", "csv"):
        tables.write(df, f"{tmp_path}/{fmt}", fmt, partition_by=["id"], rows_per_file=1)
        back = tables.read(spark, f"{tmp_path}/{fmt}", fmt, "name string, x double, id int")
        assert sorted(map(tuple, back.select("id", "name", "x").collect())) == rows, fmt
    tables.write(df.select("name").where("id = 1"), f"{tmp_path}/text", "text")
    assert [r.value for r in tables.read(spark, f"{tmp_path}/text", "text").collect()] == ["a,b"]
    with pytest.raises(ValueError, match="needs a schema"):
        tables.read(spark, f"{tmp_path}/csv", "csv")
    with pytest.raises(ValueError, match="none of"):
        tables.write(df, f"{tmp_path}/x", "xls")


def test_bucketed_tables_join_without_a_shuffle(spark):
    names = ("bucketed_left", "bucketed_right")
    for n in names:
        tables.write_bucketed(spark.range(100).withColumnRenamed("id", "k"), n, ["k"], 4, mode="overwrite")
    joined = spark.table(names[0]).hint("merge").join(spark.table(names[1]), "k")
    assert joined.count() == 100 and "Exchange hashpartitioning(k" not in joined._jdf.queryExecution().executedPlan().toString()
    for n in names:
        spark.sql(f"drop table {n}")


def test_functions_on_nulls_and_empty_texts(spark):
    texts = spark.createDataFrame([(1, "abab"), (2, ""), (3, None), (4, "é é")], "id int, t string")
    assert {r.id: r.e for r in texts.select("id", udfs.entropy("t").alias("e")).collect()} == {1: 1.0, 2: 0.0, 3: None, 4: pytest.approx(0.9182958)}
    assert sorted((r.id, r.place, r.word) for r in udfs.words_of(texts, F.col("t")).collect()) == [(1, 0, "abab"), (4, 0, "é"), (4, 1, "é")]
    values = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 5.0), ("a", 9.0), ("b", None), (None, 2.0)], "k string, v double")
    assert {r.k: r.median for r in udfs.median_by(values, ["k"], "v").collect()} == {"a": 3.0, None: 2.0}


def stream(spark, folder, schema, batches, make, mode="append"):
    """The rows that a stream over these batches, one file each, gives."""
    folder.mkdir()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    name = f"rows_{folder.name}"
    q = make(source).writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        for batch in batches:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(folder))
            q.processAllAvailable()
    finally:
        q.stop()
    return spark.sql(f"select * from {name}").collect()


def at(hour, minute=0):
    return dt.datetime(2024, 1, 1, hour, minute)


def test_sliding_and_session_windows_of_streams(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    batches = [[(at(1), "a", 1.0), (at(1, 30), "a", 2.0)], [(at(3), "a", 4.0)], [(at(9), "a", 1.0)], [(at(2), "a", 8.0)], [(at(20), "a", 1.0)]]
    got = stream(spark, tmp_path / "sliding", schema, batches, lambda s: windows.windowed_counts(s, windows.sliding("2 hours", "1 hour")))
    assert {(r.w.start.hour, r.n, r.total) for r in got} == {(0, 2, 3.0), (1, 2, 3.0), (2, 1, 4.0), (3, 1, 4.0), (8, 1, 1.0), (9, 1, 1.0)}
    got = stream(spark, tmp_path / "session", schema, batches, lambda s: windows.windowed_counts(s, windows.session("1 hour")))
    assert {(r.w.start, r.n, r.total) for r in got} == {(at(1), 2, 3.0), (at(3), 1, 4.0), (at(9), 1, 1.0)}


def test_first_of_each_in_streams(spark, tmp_path):
    batches = [[(1, at(1), "x"), (1, at(1, 5), "y")], [(1, at(1, 10), "z"), (2, at(2), "x")], [(2, at(2, 30), "y")], [(1, at(1), "late")]]
    got = stream(spark, tmp_path / "dedup", "k int, ts timestamp, v string", batches, lambda s: windows.first_of_each(s, ["k"]))
    assert sorted(r.k for r in got) == [1, 2]
    batch = spark.createDataFrame([r for b in batches for r in b], "k int, ts timestamp, v string")
    assert sorted((r.k, r.v) for r in windows.first_of_each(batch, ["k"]).collect()) == [(1, "late"), (2, "x")]


def test_state_by_user(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        batches = [[(1, at(1), 7, "click"), (2, at(2), 7, "view"), (3, at(1), 8, "click")], [(4, at(3), 7, "view"), (5, at(4), 7, "click"), (6, at(4), None, "view"), (7, at(5), 8, "click")]]
        got = stream(spark, tmp_path / "state", "event_id long, ts timestamp, user_id long, event_type string", batches, state.type_changes)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert sorted(map(tuple, got)) == [(7, "click", "view", 1), (7, "view", "click", 2)]


def test_stream_drops_late_rows(spark, tmp_path):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    schema = "ts timestamp, event_type string, value double"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = windows.windowed_counts(stream, windows.tumbling("1 hour")).writeStream.format("memory").queryName("late_rows").outputMode("append").start()
    for batch in ([(t(1), "a", 1.0)], [(t(9), "a", 1.0)], [(t(1), "a", 1.0), (t(12), "a", 1.0)], [(t(20), "a", 1.0)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    q.stop()
    assert {r.w.start: r.n for r in spark.sql("select * from late_rows").collect()} == {t(1): 1, t(9): 1, t(12): 1}


def test_similarity_without_vector_0(spark, tmp_path):
    spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert registry.QUERIES["similarity_to_vector_0"](spark, str(tmp_path)).count() == 0
