"""Joins of streams, timers and the upsert sink: late, out-of-order, repeated and broken-off batches."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.streaming.joins import join_within
from millrace.streaming.timers import silence_alerts
from millrace.streaming.upserts import UpsertTable

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def run(spark, folder, schema, batches, make, name, watch=None):
    folder.mkdir()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = make(source).writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        for batch in batches:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(folder))
            q.processAllAvailable()
            if watch is not None:
                watch.append(q.lastProgress)
    finally:
        q.stop()
    return [tuple(r) for r in spark.sql(f"select * from {name}").collect()]


EVENTS = "user_id long, ts timestamp, event_type string, i int"


def _sides(events):
    a = events.where("event_type = 'click'").select("user_id", "ts", "i")
    return a, events.where("event_type = 'purchase'").select(F.col("user_id").alias("buyer"), F.col("ts").alias("bought"), F.col("i").alias("j"))


def test_join_of_two_streams(spark, tmp_path):
    batches = [
        [(1, at(0), "click", 1), (2, at(5), "click", 2), (None, at(6), "click", 3)],
        [(1, at(59), "purchase", 10), (1, at(60), "purchase", 11), (1, at(61), "purchase", 12), (2, at(4), "purchase", 13)],
        [(1, at(200), "click", 4), (9, at(210), "purchase", 15)],
        # Behind the watermark: too late to match.
        [(2, at(20), "purchase", 14), (9, at(400), "purchase", 16), (1, at(400), "click", 5)],
        [(1, at(900), "click", 6), (9, at(900), "purchase", 17)],
        [(1, at(901), "click", 7), (9, at(901), "purchase", 18)],
    ]
    watch = []
    got = run(spark, tmp_path / "in", EVENTS, batches, lambda s: join_within(*_sides(s), ("user_id", "buyer"), ("ts", "bought"), 3600), "joined", watch)
    pairs = Counter((r[2], r[5]) for r in got)
    # Clicks that nobody bought after come out once their hour has passed; those of the end are still waited for.
    assert pairs == Counter([(1, 10), (1, 11), (2, None), (3, None), (4, None), (5, None)])
    assert watch[-1]["stateOperators"][0]["numRowsTotal"] < 10
    everything = spark.createDataFrame([r for b in batches for r in b], EVENTS)
    batch = Counter((r.i, r.j) for r in join_within(*_sides(everything), ("user_id", "buyer"), ("ts", "bought"), 3600).collect())
    assert batch == Counter([(1, 10), (1, 11), (2, 14), (3, None), (4, None), (5, None), (6, None), (7, None)])
    assert Counter((r.i, r.j) for r in join_within(*_sides(everything), ("user_id", "buyer"), ("ts", "bought"), 3600, how="inner").collect()) == Counter([(1, 10), (1, 11), (2, 14)])
    with pytest.raises(ValueError, match="neither"):
        join_within(*_sides(everything), ("user_id", "buyer"), ("ts", "bought"), 3600, how="outer")


def test_batch_join_against_all_pairs(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice([None, 1, 1, 1, 2]), rnd.choice([None, *[at(rnd.randint(0, 300))] * 9]), rnd.choice(["click", "purchase"]), i) for i in range(200)]
    for few in (rows, []):
        got = Counter((r.i, r.j) for r in join_within(*_sides(spark.createDataFrame(few, EVENTS)), ("user_id", "buyer"), ("ts", "bought"), 1800).collect())
        expected = Counter()
        for u, t, kind, i in few:
            if kind == "click":
                found = [j for v, s, k, j in few if k == "purchase" and u is not None and u == v and None not in (s, t) and dt.timedelta() <= s - t <= dt.timedelta(minutes=30)]
                expected.update((i, j) for j in found or [None])
        assert got == expected


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def test_silence_ends_state(spark, tmp_path, rocksdb):
    batches = [
        [(1, at(10), "a", 0), (1, at(0), "b", 0), (2, at(5), "a", 0), (None, at(5), "a", 0), (3, None, "a", 0)],
        [(1, at(5), "a", 0), (1, at(100), "a", 0), (2, at(20), None, 0)],  # the first is late, but in time
        [(4, at(300), "a", 0)],
        [(4, at(310), "a", 0), (1, at(3), "a", 0)],  # behind the watermark
        [(5, at(800), "a", 0)],
        [(5, at(801), "a", 0)],
    ]
    watch = []
    got = run(spark, tmp_path / "in", EVENTS, batches, lambda s: silence_alerts(s, 30 * 60), "silent", watch)
    expected = {(1, at(0), at(10), 3, 2), (1, at(100), at(100), 1, 1), (2, at(5), at(20), 2, 2), (4, at(300), at(310), 2, 1)}
    assert set(got) == expected and len(got) == 4
    # What is left is of user 5 alone: a span, a type, a timer.
    rows = [w["stateOperators"][0]["numRowsTotal"] for w in watch if w and w["stateOperators"]]
    assert rows[-1] < max(rows)
    everything = spark.createDataFrame([r for b in batches for r in b if r[1] != at(3)], EVENTS)
    assert {tuple(r) for r in silence_alerts(everything, 30 * 60).collect()} == expected | {(5, at(800), at(801), 2, 1)}


CHANGES = "k int, v int, x string, gone boolean"


def test_upserts_survive_replays_and_broken_attempts(spark, tmp_path):
    kept = UpsertTable(spark, str(tmp_path / "t"), ["k"], "v", "gone")
    assert kept.read() is None
    now = lambda: sorted(map(tuple, kept.read().select("k", "v", "x").collect()))
    first = spark.createDataFrame([(1, 1, "a", False), (1, 3, "c", False), (2, 1, "a", None), (3, 2, "b", False)], CHANGES)
    assert kept.write(first, 0) and not kept.write(first, 0)
    assert now() == [(1, 3, "c"), (2, 1, "a"), (3, 2, "b")]
    second = spark.createDataFrame([(1, 2, "old", False), (2, 5, None, True), (4, 1, "n", False)], CHANGES)
    broken = second.withColumn("x", F.raise_error(F.lit("broken off")).cast("string"))
    with pytest.raises(Exception, match="broken off"):
        kept.write(broken, 1)
    assert now() == [(1, 3, "c"), (2, 1, "a"), (3, 2, "b")]
    # An attempt that wrote its files, but ended before its commit.
    commit, kept._commit = kept._commit, lambda *a: (_ for _ in ()).throw(RuntimeError("killed"))
    with pytest.raises(RuntimeError, match="killed"):
        kept.write(second, 1)
    kept._commit = commit
    assert now() == [(1, 3, "c"), (2, 1, "a"), (3, 2, "b")]
    assert kept.write(second, 1) and not kept.write(second, 1)
    expected = [(1, 3, "c"), (3, 2, "b"), (4, 1, "n")]
    assert now() == expected
    kept.compact()
    assert now() == expected and len(kept._commits()) == 1
    kept.clear()
    assert now() == expected and len(list((tmp_path / "t" / "data").iterdir())) == 1 and not kept.write(first, 0)
    # A deleted key stays so under older changes, and comes back by a newer one.
    kept.write(spark.createDataFrame([(2, 4, "late", False), (3, 9, "new", False)], CHANGES), 2)
    assert now() == [(1, 3, "c"), (3, 9, "new"), (4, 1, "n")]
    kept.write(spark.createDataFrame([(2, 6, "again", False)], CHANGES), 3)
    kept.write(spark.createDataFrame([], CHANGES), 4)
    assert now() == [(1, 3, "c"), (2, 6, "again"), (3, 9, "new"), (4, 1, "n")]


def test_upserts_of_a_stream_that_starts_anew(spark, tmp_path):
    (tmp_path / "in").mkdir()
    kept = UpsertTable(spark, str(tmp_path / "t"), ["k"], "v", "gone")
    calls = []

    def apply(changes, batch_id):
        calls.append(kept.write(changes, batch_id))
        if len(calls) == 2:
            raise RuntimeError("killed behind the commit")

    for n in range(2):
        spark.createDataFrame([(1, n, f"x{n}", False), (n + 5, 0, "y", False)], CHANGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = spark.readStream.schema(CHANGES).parquet(str(tmp_path / "in")).writeStream.foreachBatch(apply).option("checkpointLocation", str(tmp_path / "at")).start()
        if n == 0:
            q.processAllAvailable()
        else:
            with pytest.raises(Exception, match="killed"):
                q.processAllAvailable()
        q.stop()
    q = spark.readStream.schema(CHANGES).parquet(str(tmp_path / "in")).writeStream.foreachBatch(apply).option("checkpointLocation", str(tmp_path / "at")).start()
    q.processAllAvailable()
    q.stop()
    assert calls == [True, True, False]
    assert sorted(map(tuple, kept.read().select("k", "v", "x").collect())) == [(1, 1, "x1"), (5, 0, "y"), (6, 0, "y")]
