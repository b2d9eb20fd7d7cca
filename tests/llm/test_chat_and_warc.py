import base64
import decimal
import hashlib
import io
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import chat, registry, warc
from tests.oracle import SF_DIR, check

TEXT = st.lists(st.sampled_from(["\\", "###", "#", "</turn>", " </turn>\n", ": ", " ", "\n", "a", "é", "### assistant: "])).map("".join)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
def test_turns_survive_the_template(turns):
    formatted = "".join(chat._Turn(r, t).formatted for r, t in turns)
    assert [(r, t) for r, t, _, _ in chat.parse(formatted)] == turns


def check_windows(windows, turns, budget):
    """windows: rows of one conversation, sorted; turns: its (role, text)."""
    seen, loss = [], []
    for first, n_new, repeated, tokens, formatted, spans in windows:
        found = [(r, t) for r, t, _, _ in chat.parse(formatted)]
        assert first == len(seen) and len(found) == repeated + n_new and n_new
        assert tokens == sum(chat.count_tokens(chat._Turn(r, t).formatted) for r, t in found) == chat.count_tokens(formatted)
        assert tokens <= budget or (n_new == 1 and repeated == 0)
        if first and turns[0][0] == "system":
            fits = chat.count_tokens(chat._Turn(*turns[0]).formatted + chat._Turn(*turns[first]).formatted) <= budget
            assert (repeated > 0 and found[0] == turns[0]) == fits
        seen += found[repeated:]
        loss += [chat.unescape(formatted[a:b]) for a, b in spans]
    assert seen == turns and loss == [t for r, t in turns if r == "assistant"]


@settings(deadline=None, max_examples=100)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant"]), st.integers(0, 9)), max_size=30), st.integers(1, 60))
def test_windows_hold_every_turn_once(turns, budget):
    turns = [(role, f"{k} " * n) for k, (role, n) in enumerate(turns)]
    windows = list(chat._cut(iter([(1, 0, False, None, *t) for t in turns]), budget, 2, 24, chat.count_tokens))
    check_windows([w[1:] for w in windows], turns, budget)


def digests(rows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = "".join(t or "" for r, t in rows if r == "assistant")
    return len(rows), sha("".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)), len(loss), sha(loss)


def test_query_against_the_rows(spark):
    turns = spark.read.parquet(f"{SF_DIR}/conversations.parquet").orderBy("conv_id", "turn").collect()
    expected = {-7: [("user", registry.PLANTED), ("assistant", registry.PLANTED)]}
    for r in turns:
        expected.setdefault(r.conv_id, []).append((r.role, r.text))
    got = registry.op4_chat_windows(spark, SF_DIR).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == {k: digests(v) for k, v in expected.items()}


def test_small_budget_nulls_and_repeats(spark):
    rows = [(1, k, "system" if not k else ("user", "assistant")[k % 2], f"turn {k} " * 5) for k in range(20)] + [(None, 1, None, None), (None, None, "assistant", ""), (2, 0, "assistant", "x"), (2, 0, "assistant", "x")]
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn int, role string, text string, first_turn string")
    windows = chat.format_windows(frame, budget=80)
    assert windows.where("conv_id = 1").count() > 3
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(windows).collect()}
    assert got == {1: digests([r[2:] for r in rows[:20]]), None: digests([("assistant", ""), (None, None)]), 2: digests([("assistant", "x")] * 2)}
    assert chat.read_back(chat.format_windows(frame.limit(0))).count() == 0


def test_ids_come_back_as_they_were(spark):
    large = 9007199254740993
    for kind, ids in (("long", [large, large - 1, None]), ("string", ["", "a", None]), ("decimal(30,2)", [decimal.Decimal("1.20"), None]), ("struct<a:int,b:string>", [(1, None), (1, "x"), None]), ("double", [float("nan"), 1.5])):
        rows = [(i, k, "user", f"{i} {k}") for k in range(3) for i in ids]
        got = chat.read_back(chat.format_windows(spark.createDataFrame(rows, f"conv_id {kind}, turn int, role string, text string"))).collect()
        assert Counter(repr(tuple(r.conv_id) if isinstance(r.conv_id, tuple) else r.conv_id) for r in got) == Counter(map(repr, ids))
        assert all(r.n_turns == 3 for r in got)


def test_budget_counts_the_turns_as_laid_out():
    ok = [(1, 0, False, None, "user", "ok")] * 3000
    assert all(w[4] <= 2048 and w[4] == chat.count_tokens(w[5]) for w in chat._cut(iter(ok), 2048, 2, 512, chat.count_tokens))
    with_system = [(1, 0, False, None, "system", "s " * 2020)] + [(1, 0, False, None, "user", "w " * 20)] * 9
    assert all(w[4] <= 2048 for w in chat._cut(iter(with_system), 2048, 2, 512, chat.count_tokens))


def test_windows_read_back_from_any_order(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    windows = chat.format_windows(turns, budget=300)
    assert windows.count() > turns.select("conv_id").distinct().count()
    plain, dealt = (sorted(map(tuple, chat.read_back(w).collect())) for w in (chat.format_windows(turns, budget=300), windows.repartition(7)))
    assert plain == dealt and len(plain) == 100


def test_long_conversations_in_chunks(spark):
    """Of a hot conversation, and of the rows without an id; many empty turns; one very long text."""
    rows = [(5, k, "system" if not k else ("user", "assistant")[k % 2], f"turn {k} ### " * (k % 7)) for k in range(3000)]
    rows += [(None, k // 3, "assistant", f"{k}") for k in range(1000)] + [(6, 0, "user", "short")] + [(7, 0, "user", "y"), (7, 1, "assistant", "long text </turn>\n" * 20_000)]
    frame = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(5)
    windows = chat.format_windows(frame, budget=400, chunk_chars=5000)
    by = {}
    for r in windows.collect():
        by.setdefault(r.conv_id, []).append(tuple(r)[1:])
    # Equal turn numbers are in the order of a hash.
    order = {r: k for k, r in enumerate(map(tuple, frame.orderBy("conv_id", "turn", "role", F.xxhash64("text")).collect()))}
    for conv_id, found in by.items():
        check_windows(sorted(found), [r[2:] for r in sorted((r for r in rows if r[0] == conv_id), key=order.get)], 400)
    # A window after a chunk's begin repeats the turns before it as any other does.
    assert all(w[2] >= 2 for w in by[5] if w[0]) and len(by[5]) > 30
    whole = {r.conv_id: r[1:5] for r in chat.read_back(chat.format_windows(frame)).collect()}
    assert {r.conv_id: r[1:5] for r in chat.read_back(windows).collect()} == whole
    many = spark.range(100_000).select(F.lit("hot").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("").alias("text"))
    assert chat.format_windows(many).agg(F.sum("n_new"), F.max("n_tokens")).first()[:] == (100_000, 2043)


def test_archive_round_trip():
    records = [warc.record(i, f"http://a/{i} é\r\n", (f"<p>{i}</p>" * i).encode(), warc.payload_digest((f"<p>{i}</p>" * i).encode()), None, False) for i in range(40)]
    for dictionary in (warc.build_dictionary(records), warc.build_dictionary([])):
        w = warc.ArchiveWriter(dictionary)
        for r in records:
            w.add(r)
        assert list(warc.read_records(io.BytesIO(w.out.getvalue()), read_size=37)) == records
        with pytest.raises(ValueError, match="within a record"):
            list(warc.read_records(io.BytesIO(w.out.getvalue()[:-3])))


def test_revisits_of_a_hot_payload(spark):
    rows = [(k, "" if k % 3 else f"p{k % 7}") for k in range(300)] + [(None, ""), (1000, None), (1001, "alone")]
    pages = spark.createDataFrame(rows, "page_id long, html string").selectExpr("page_id", "'u' as url", "html").repartition(5)
    plain = {r.page_id: r.refers_to for r in warc.with_revisits(pages).collect()}
    found = warc.with_revisits(pages, broadcast_rows=0, hot_rows=100)
    assert {r.page_id: r.refers_to for r in found.collect()} == plain and found.count() == len(rows)
    last = {html or "": max(k for k, h in rows if k is not None and (h or "") == (html or "")) for _, html in rows}
    assert plain == {k: None if last[h or ""] == k else last[h or ""] for k, h in rows}


def test_dictionary_sample_of_whole_payloads(spark):
    pages = spark.createDataFrame([(k, "p" * (100 + k)) for k in range(50)] + [(99, "q" * 9000), (None, None)] + [(7, "same" * 40)] * 9, "page_id long, html string")
    whole = {("p" * (100 + k)).encode() for k in range(50)} | {b"", b"same" * 40}
    for records, size in ((1000, 100_000), (20, 100_000), (1000, 3000), (0, 10)):
        found = warc._sample(pages.repartition(4), records, size)
        assert len(found) <= records and sum(map(len, found)) <= size and set(found) <= whole | {b"q" * 9000}
        assert found == warc._sample(pages, records, size)
    assert len(warc._sample(pages, 1000, 100_000)) == 61 and len(warc._sample(pages, 20, 100_000)) > 8


def test_warc_query(spark):
    assert check(spark, registry.op5_warc, registry.ORACLE_SQL["op5_warc"]) == 50


@pytest.mark.parametrize("rows_broadcast", [0, 1000])
def test_revisits_nulls_and_small_archives(spark, tmp_path, rows_broadcast):
    rows = [(1, "http://a/", "x"), (4, None, "x"), (2, "u v", "x"), (3, "b", None), (7, "b", ""), (None, "c", "y"), (5, "d", "z" * 100_000)]
    pages = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, sha1 string")
    path = f"file://{tmp_path}/w"
    manifest = warc.write_archives(pages, path, archive_bytes=200, broadcast_rows=rows_broadcast)
    assert manifest.count() > 1
    got = {r.page_id: r for r in warc.read_archives(manifest, path).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 4), 2: ("revisit", 4), 4: ("response", None), 3: ("revisit", 7), 7: ("response", None), None: ("response", None), 5: ("response", None)}
    for page_id, _, html in rows:
        data = (html or "").encode()
        assert (got[page_id].payload_bytes, got[page_id].payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    assert warc.read_archives(warc.write_archives(pages.limit(0), path), path).count() == 0
    assert {r.record_type for r in warc.read_archives(warc.write_archives(pages, path, min_bytes=2), path).collect()} == {"response"}
