"""The log of segments (replays, broken attempts, pruning, restarts) and VARIANT, against plain Python."""

import json
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.functions import variants
from millrace.plans import analytics
from millrace.sources import segments
from tests import oracle

SCHEMA = "id long, name string, at timestamp, xs array<int>"


@pytest.mark.parametrize("name", ["segmented_pages", "typed_properties", "property_paths", "property_schemas"])
def test_queries_against_sql(spark, name):
    assert oracle.check(spark, analytics.QUERIES[name], analytics.ORACLE_SQL[name]) > 0


def _rows(lo, hi):
    return [(k, None if k % 5 == 0 else f"n{k}" * (k % 7), None, None if k % 3 == 0 else [k, None]) for k in range(lo, hi)]


def _df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_log_gives_back_all_rows_and_no_batch_twice(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    odd = [(None, None, None, None), (None, "", None, []), (7, "x" * 3_000_000, None, None), (7, "tie", None, None), (7, "tie", None, None)]
    segments.append(_df(spark, odd), path, "id", 0)
    segments.append(_df(spark, _rows(0, 1000)), path, "id", 3, segment_rows=90)
    segments.append(_df(spark, []), path, "id", 4)
    segments.append(_df(spark, _rows(5000, 5010)), path, "id", 3)  # A replay: what is there stays.
    # What a broken attempt leaves: a segment that no batch names, and a batch's file before its rename.
    data = Path(tmp_path, "log", "data")
    (data / "orphan.arrows").write_bytes(next(data.glob("*.arrows")).read_bytes())
    Path(tmp_path, "log", "batches", f"{9:020d}.json.abc.open").write_text("{")
    got = Counter(repr(tuple(r)) for r in segments.read(spark, path).collect())
    expected = Counter(repr(tuple(r)) for r in _df(spark, odd + _rows(0, 1000)).collect())
    assert got == expected
    some = segments.read(spark, path, ["xs", "id"])
    assert some.columns == ["xs", "id"] and some.where("id = 4").first().xs == [4, None]
    for bad, why in (((_df(spark, []), path, "id", 2), "after batch"), ((_df(spark, []).drop("xs"), path, "id", 9), "schema"), ((_df(spark, []), path, "name", 9), "whole number"), ((_df(spark, []), path, "id", -1), "at least")):
        with pytest.raises(ValueError, match=why):
            segments.append(*bad)


def test_filters_on_the_key_leave_out_segments(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    segments.append(_df(spark, _rows(0, 1000)).coalesce(1), path, "id", 0, segment_rows=100)
    segments.append(_df(spark, [(None, "none", None, None)]), path, "id", 1)
    for test, n_segments in (("id = 250", 1), ("id in (5, 950)", 2), ("id >= 900", 1), ("id > 899", 1), ("id < 100", 1), ("id <= 100", 2), ("id between 150 and 320", 3), ("id is null", 11), ("name = 'n1'", 11), ("id > 5000", 0)):
        found = segments.read(spark, path).where(test)
        expected = _df(spark, [*_rows(0, 1000), (None, "none", None, None)]).where(test)
        assert sorted(map(repr, found.collect())) == sorted(map(repr, expected.collect())), test
    # The same as tasks: how many segments are read.
    reader = segments._Reader(path, ["id"])
    for f, n in ((segments.EqualTo(("id",), 250), 1), (segments.In(("id",), (5, 950)), 2), (segments.LessThanOrEqual(("id",), 100), 2), (segments.EqualTo(("name",), "n1"), 11), (segments.GreaterThan(("id",), 5000), 0)):
        assert list(reader.pushFilters([f])) == [f]
        assert sum(len(t.names) for t in reader.partitions()) == n
    assert sum(len(t.names) for t in reader.partitions()) == 0


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    out = str(tmp_path / "out")

    def run():
        q = segments.read_stream(spark, path, ["id"]).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
        q.awaitTermination(60)
        assert q.exception() is None and not q.isActive
        return Counter(r.id for r in spark.read.schema("id long").parquet(out).collect())

    segments.append(_df(spark, _rows(0, 50)), path, "id", 0, segment_rows=7)
    assert run() == Counter(range(50))
    segments.append(_df(spark, _rows(50, 60)), path, "id", 1)
    segments.append(_df(spark, _rows(50, 60)), path, "id", 1)
    segments.append(_df(spark, _rows(40, 70)), path, "id", 2)
    twice = Counter(range(70)) + Counter(range(40, 60))
    # The last batch takes 40 to 69 anew: rows repeat as often as batches have them, no more.
    assert run() == twice
    assert run() == twice
    q = segments.read_stream(spark, path, ["id"], after_batch=1).writeStream.format("memory").queryName("late").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert Counter(r.id for r in spark.sql("select id from late").collect()) == Counter(range(40, 70))


def _document(rnd, depth):
    kind = rnd.choice("osabnif" if depth else "sbnif")
    if kind == "o":
        return {rnd.choice(["a", "b", "c.d", "é", ""]): _document(rnd, depth - 1) for _ in range(rnd.randint(0, 3))}
    if kind == "a":
        return [_document(rnd, depth - 1) for _ in range(rnd.randint(0, 3))]
    return {"s": rnd.choice(["", "12", "x"]), "b": rnd.random() < 0.5, "n": None, "i": rnd.randint(-9, 9), "f": rnd.choice([0.5, 1e300])}[kind]


def _kind(x):
    return {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null", int: "integer", float: "number"}[type(x)]


def _walk(x, path="$"):
    yield path, _kind(x)
    for step, inner in [(f".{k}", v) for k, v in x.items()] if isinstance(x, dict) else [("[*]", v) for v in x] if isinstance(x, list) else []:
        yield from _walk(inner, path + step)


def test_paths_against_plain_python(spark):
    rnd = random.Random(4)
    found = [(rnd.choice([None, "hot", "hot", "hot", "x"]), _document(rnd, 4)) for _ in range(300)]
    expected = Counter((g, *node) for g, x in found for node in _walk(x))
    rows = [(g, json.dumps(x)) for g, x in found] + [("hot", None), ("hot", "{"), ("hot", ""), (None, "nul")]
    df = spark.createDataFrame(rows, "`g h` string, s string").repartition(3).withColumn("v", variants.parsed(F.col("s")))
    got = {(r["g h"], r.path, r.kind): r.n for r in variants.path_counts(df, "v", ["g h"]).collect()}
    assert got == dict(expected) and len(got) > 50
    assert variants.path_counts(df.limit(0), "v", ["g h"]).count() == 0
    assert variants.nodes(df, "v", []).count() == sum(expected.values())


def test_kinds_and_schemas(spark):
    rows = [(1, '{"k": 5}'), (1, '{"k": 6, "u": [1]}'), (2, '{"k": "5"}'), (2, '{"k": 5}'), (3, None), (3, "{"), (4, '{"k": 1.5}'), (5, '{"k": null}')]
    df = spark.createDataFrame(rows, "g int, s string").withColumn("v", variants.parsed(F.col("s")))
    v = F.col("v")
    whole = variants.of_kind(v, "$.k", ("integer",), "bigint")
    assert sorted(map(str, [r[0] for r in df.select(whole).collect()])) == ["5", "5", "6", "None", "None", "None", "None", "None"]
    kinds = Counter(r[0] for r in df.select(variants.kind(variants.at(v, "$.k"))).collect())
    assert kinds == {"integer": 3, "string": 1, None: 2, "number": 1, "null": 1}
    merged = {r.g: r.m for r in df.groupBy("g").agg(variants.merged_schema(v).alias("m")).collect()}
    assert merged[1] == "OBJECT<k: BIGINT, u: ARRAY<BIGINT>>" and merged[2] == "OBJECT<k: VARIANT>"
