from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import decontaminate as dc
from millrace.llm.common import table
from tests.llm.test_duplicates import components, plain_fingerprint
from tests.llm.test_sharding_mixing_pii import plain_jump, plain_targets
from tests.llm.test_urls_and_leaks import brute
from tests.oracle import SF_DIR

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_against_brute_force(spark):
    """Each stage on what the one before kept; columns stay until the last."""
    docs = table(spark, SF_DIR, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == columns
        docs = corpus_pipeline.materialize(docs, "test")
        kept[name] = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    quality, near, clean, mixed = kept.values()
    good = {r.doc_id for r in table(spark, SF_DIR, "labels").where("quality = 1").collect()}
    assert len(good & {r[0] for r in quality}) >= 0.95 * len(good)

    of = components({i: plain_fingerprint(t) for i, _, t in quality})
    assert {r[0] for r in near} == set(of.values()) and len(near) == len(set(of.values()))

    items = [tuple(r) for r in table(spark, SF_DIR, "benchmark").collect()]
    leaked, most = ({d for d, _ in brute([(i, t) for i, _, t in near], items, spread=x)} for x in (2.0, 2.5))
    gone = {r[0] for r in near} - {r[0] for r in clean}
    assert leaked and leaked <= gone <= most and len(clean) == len(near) - len(gone)

    sizes, taken = Counter(), Counter()
    for _, s, t in clean:
        sizes[s] += len(t.split())
    for _, s, t in mixed:
        taken[s] += len(t.split())
    longest = max(len(t.split()) for _, _, t in clean)
    assert {r[0] for r in mixed} <= {r[0] for r in clean} and max(Counter(r[0] for r in mixed).values()) <= 3
    assert all(abs(taken[s] - x) <= longest for s, x in plain_targets(sizes).items())

    sharded = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    assert Counter(r.doc_id for r in sharded) == Counter(r[0] for r in mixed)
    assert all(r.shard == plain_jump(r.doc_id, 16) for r in sharded)


def test_near_duplicate_stage_with_repeats_and_nulls(spark, monkeypatch):
    rows = [(1, "a b c d e", "en", "s", 9), (1, "a b c d e", "en", "s", 9), (2, "A b c d e", "en", "s", 9), (None, "x y", "en", None, 3), (3, None, None, None, None), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, table(spark, SF_DIR, "documents").schema)
    got = corpus_pipeline.near_duplicates(spark, docs, SF_DIR).collect()
    assert sorted((r.doc_id or -1) for r in got) == [-1, 1, 3]
    # The same where nothing may be broadcast and rows that repeat are hot.
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(corpus_pipeline, "HOT_ROWS", 20)
    many = docs.unionByName(docs.where("doc_id = 2 or doc_id is null or doc_id = 3").withColumn("_x", F.explode(F.sequence(F.lit(1), F.lit(30)))).drop("_x"))
    again = corpus_pipeline.near_duplicates(spark, many, SF_DIR).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert corpus_pipeline.mix(spark, docs, SF_DIR).count() <= 3 * len(rows)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), SF_DIR).count() == 0
    assert dc.tokens("A b") == ["a", "b"]


def test_run(spark):
    assert corpus_pipeline.run(spark, SF_DIR).columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


@pytest.mark.parametrize("labelled", [[], [(1, 1, 0)], [(1, 0, 0)], [(1, 0, 0), (1, 1, 0), (9, 1, 0), (None, 1, 0)]])
def test_quality_stage_keeps_all_without_a_curve(spark, tmp_path, labelled):
    spark.createDataFrame(labelled, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, "a b c", "en", "s", 5), (2, None, None, None, None), (None, "", "en", "s", 0), (2, "x y", "en", "s", 3)]
    docs = spark.createDataFrame(rows, table(spark, SF_DIR, "documents").schema)
    got = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and Counter(map(tuple, got.collect())) == Counter(rows)
