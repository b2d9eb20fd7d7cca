"""Every operator and stage on odd rows: nulls, empty and very long texts, repeats, clashing extra columns, no rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, common, compression_classifier, decontaminate, mixing, pii, quality_rules, sharding, simhash, url_filter, warc
from millrace.llm.common import table
from tests.oracle import SF_DIR

corpus_pipeline = pytest.importorskip("corpus_pipeline")

LONG = " ".join(f"word{i % 977} mail{i}@host.example +44 20 7946 {i:04d}" for i in range(8_000)) + " " + "x" * 200_000 + "7" * 100_000 + "@" * 50_000
ROWS = [
    (1, "one two three four five", "en", "a", 23),
    (1, "one two three four five", "en", "a", 23),
    (1, "another text of the same id", "en", "b", 27),
    (2, "", "en", "a", 0),
    (3, " \t\n\r\n", None, None, None),
    (4, None, "en", "a", 0),
    (None, "no id but a text 4111 1111 1111 1111", None, None, None),
    (None, None, None, None, None),
    (5, LONG, "en", "hot", len(LONG)),
]
#: Names that operators use themselves, results or inner ones, in several cases; one with a dot.
CLASHING = ["_key", "_row", "_id", "_h", "_words", "_s", "_q", "_extra", "key", "least", "n", "FP", "Score", "matches", "shard", "Size", "found", "kept", "rule", "_d", "a.b"]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, table(spark, SF_DIR, "documents").schema)
    return plain.select("*", *[F.lit(f"of {c}").alias(c) for c in CLASHING])


def operators(spark):
    benchmark = spark.createDataFrame([(1, "an item\nof the test"), (None, None), (2, "")], "item_id long, text string")
    rules = url_filter.rules_frame(spark, [("block", "example.com", "/"), ("allow", None, None)])
    model = compression_classifier.Model(b"", b"", 0.0, 0.0)
    return {
        "quality_rules": (lambda d: quality_rules.quality_rules(d, quality_rules.ngram_log_ratios(d, d.limit(0))), ["kept", "n_words"]),
        "simhash": (simhash.near_duplicates, ["fp", "component_id"]),
        "classifier": (lambda d: compression_classifier.score(d, model), ["score", "predicted"]),
        "urls": (lambda d: url_filter.filter_urls(d.withColumn("text", F.when(F.col("doc_id") == 5, F.concat(F.lit("HTTP://"), "text")).otherwise(F.col("text"))).withColumnRenamed("text", "url"), rules), ["rule", "verdict"]),
        "decontamination": (lambda d: decontaminate.find_contamination(d, benchmark), ["matches"]),
        "sharding": (sharding.shard, ["shard", "slot", "size"]),
        "pii": (pii.personal_data, ["found"]),
        "mixing": (mixing.mix, ["size", "taken"]),
    }


@pytest.mark.parametrize("name", ["quality_rules", "simhash", "classifier", "urls", "decontamination", "sharding", "pii", "mixing"])
def test_operators_keep_rows_and_extra_columns(spark, docs, name):
    run, results = operators(spark)[name]
    out = run(docs)
    assert set(results) <= set(out.columns) and len({c.lower() for c in out.columns}) == len(out.columns)
    replaced = {c.lower() for c in run(docs.select("doc_id", "text", "source")).columns}
    passed = [c for c in CLASHING if c.lower() not in replaced]
    assert set(passed) <= set(out.columns)
    rows = out.drop("text", "url").collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ROWS)
    assert all(r[c] == f"of {c}" for r in rows for c in passed)
    none = run(docs.limit(0))
    assert none.columns == out.columns and none.count() == 0


def test_conversations_and_archives_of_odd_rows(spark, docs, tmp_path):
    clashing = [c for c in docs.columns if c in CLASHING]
    extra = [F.lit("x").alias(c) for c in ("window", "_chunk", "_known", "_number", "_long", "sha1", "refers_to", "_large")]
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.col("source").alias("role"), "text", *[f"`{c}`" for c in clashing], *extra)
    ids = Counter(r[0] for r in ROWS)
    for chars in (chat.CHUNK_CHARS, 10):
        got = {r.conv_id: r for r in chat.read_back(chat.format_windows(turns, chunk_chars=chars)).collect()}
        assert {i: r.n_turns for i, r in got.items()} == ids and got[5].formatted_chars > len(LONG)
    assert chat.format_windows(turns.limit(0)).count() == 0
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), *[f"`{c}`" for c in clashing], *extra)
    path = f"file://{tmp_path}/w"
    rows = warc.read_archives(warc.write_archives(pages, path), path).collect()
    assert Counter((r.page_id, r.payload_bytes) for r in rows) == Counter((r[0], len((r[1] or "").encode())) for r in ROWS)
    # Of the empty payloads, that of the largest id is the response; equal rows of that id are, each.
    assert {(r.page_id, r.record_type, r.refers_to) for r in rows if not r.payload_bytes} == {(4, "response", None), (2, "revisit", 4), (None, "revisit", 4)}
    assert [r.record_type for r in rows if r.page_id == 1] == ["response"] * 3


def test_shared_folder_must_be_named_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master, applicationId = "yarn", "x"

            @staticmethod
            def getConf():  # noqa: N802
                return {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def test_small_is_a_matter_of_rows_and_bytes(spark):
    wide = spark.createDataFrame([("x" * 1000, [1, None])] * 10, "a string, b array<int>")
    assert common.is_small(wide) and common.is_small(wide.limit(0)) and not common.is_small(wide, rows=9) and not common.is_small(wide, size=10_000)


def test_found_in_odd_rows(spark, docs):
    found = {r.doc_id: [s.kind for s in r.found if s.kind != "id"] for r in pii.personal_data(docs).collect() if r.doc_id is None and r.found or r.doc_id == 5}
    assert found[None] == ["card"] and found[5].count("email") == 8_000
    near = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs).select("doc_id", "fp", "component_id").collect()}
    assert near[2, 0] == near[3, 0] == near[4, 0] == near[None, 0] == 2


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_keep_columns(spark, docs, k):
    name, stage = corpus_pipeline.STAGES[k]
    out, none = stage(spark, docs, SF_DIR), stage(spark, docs.limit(0), SF_DIR)
    assert none.columns == out.columns and none.count() == 0
    rows = out.collect()
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns
        assert all(r[c] == f"of {c}" for r in rows for c in CLASHING)
    if name == "SimHash near-dedup":
        assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "5", "None", "None"]
