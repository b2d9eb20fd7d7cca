import hashlib
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import mixing, pii, registry, sharding
from millrace.llm.common import join_unique, left_join_unique, running_sums
from tests.oracle import SF_DIR, check


def plain_jump(key, shards):
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_and_growth():
    keys = np.array([*range(-50, 2000), 2**63 - 1, -(2**63)], np.int64)
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]
    a, b = sharding.jump_hash(keys, 16), sharding.jump_hash(keys, 17)
    assert ((a == b) | (b == 16)).all() and 0 < (a != b).mean() < 0.12


def test_slots_sizes_and_odd_rows(spark):
    rows = [(k, f"é{k}", 1) for k in range(300)] + [(3, None, 1), (3, None, 1), (None, "", 1), (5, "x" * 50_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(7)
    got = sharding.shard(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert (r.shard, r.grown_shard, r.law) == (plain_jump(r.doc_id or 0, 16), plain_jump(r.doc_id or 0, 17), "key")
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(docs.limit(0)).count() == 0


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    cut, total = set(), sum(sizes.values())
    while True:
        left, rest = total - sum(3 * sizes[s] for s in cut), [s for s in names if s not in cut]
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s for s in rest if share[s] > 3 * sizes[s]}
        if not over:
            return {s: float(3 * sizes[s]) if s in cut else share[s] for s in names}
        cut |= over


def test_targets_against_rounds_of_cutting(spark):
    for sizes in ({"a": 100, "b": 5, None: 300, "B": 7, "é": 50, "z": 1}, {"a": 3}, {"a": 0, "b": 10}, {"a": 1, "b": 1, "c": 1000, "d": 90}, {"a": 0, "b": 0}):
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(frame).collect()}
        for s, x in plain_targets(sizes).items():
            assert abs(got[s] - x) < 1e-6, (sizes, s)


def test_mix_is_near_its_targets_and_repeats(spark):
    rows = [(k, ("a", "b", None, "c")[min(k % 7, 3)], "w " * (k % 40), "x") for k in range(4000)] + [(1, "b", None, "x"), (None, "b", "q r", "x"), (None, "b", "q r", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, taken string")
    got = mixing.mix(docs.repartition(5), slice_rows=7).collect()
    key = lambda r: (r.doc_id or -1, r.source or "", r.size, r.taken)
    again = mixing.mix(docs.repartition(2), broadcast_rows=0).collect()
    texts = mixing.mix(docs.repartition(3), keep_text=True).collect()
    assert sorted(map(key, got)) == sorted(map(key, again)) == sorted(map(key, texts)) and len(got) == len(rows)
    assert Counter((r.doc_id, r.text) for r in texts) == Counter((r[0], r[2]) for r in rows)
    sums, target = Counter(), {}
    for r in got:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        sums[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(sums[s] - t) <= max(20, t / 100) for s, t in target.items())
    assert mixing.mix(docs.limit(0)).count() == 0


SIZES = [20, 21, 22, 23, 20, 22, 23, 23, 40, 45, 46, 47, 3]


def test_inclusion_frequencies_are_the_probabilities(spark):
    """1,200 sources of the same sizes, half with p = 0.2 and half with p = 0.8 of their words in the sample."""
    docs = spark.createDataFrame([(100 * s + k, f"s{s:04d}", "w " * n) for s in range(1200) for k, n in enumerate(SIZES)], "doc_id long, source string, text string")
    got = mixing.mix(docs, weights=(3, 2)).collect()
    seen, per_class, in_order = Counter(), defaultdict(Counter), 0
    for r in got:
        odd, whole = int(r.source[1:]) % 2, 0 if int(r.source[1:]) % 2 else 1
        assert r.copies - whole in (0, 1)
        seen[odd, r.size] += r.copies - whole
        per_class[odd, r.size < 24, r.size > 24][r.source] += r.copies - whole
    assert all(len(set(c.values())) == 1 for c in per_class.values())  # the number is fixed
    for odd in (0, 1):
        for sizes in ([n for n in SIZES if 19 < n < 24], [n for n in SIZES if 39 < n < 48]):
            m, mean = sum(seen[odd, n] for n in set(sizes)) / 600 / len(sizes), sum(sizes) / len(sizes)
            assert 0 < m < 1
            for n in set(sizes):
                p, trials = m + m * (1 - m) * (n / mean - 1), 600 * sizes.count(n)
                # Pareto sampling meets the probabilities nearly; four deviations and a hundredth.
                assert abs(seen[odd, n] / trials - p) < 0.01 + 4 * (p * (1 - p) / trials) ** 0.5, (odd, n)
    # Inclusion is by size as well as by chance: not the documents of least u in each class.
    u = lambda i, n: int(hashlib.md5(f"millrace-mix:{i}:{hashlib.md5(('w ' * n).encode()).hexdigest()}".encode()).hexdigest()[:13], 16)
    by = defaultdict(list)
    for r in got:
        by[r.source, r.size > 24].append((u(r.doc_id, r.size), r.copies)) if r.size > 3 else None
    in_order = [[c for _, c in sorted(x)] == sorted((c for _, c in x), reverse=True) for x in by.values()]
    assert 0 < sum(in_order) < len(in_order)


def test_equal_rows_at_a_samples_end(spark):
    rows = [(1, "a", "x y z")] * 500 + [(None, "a", "p q r")] * 300 + [(k, "b", "w") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6)
    for broadcast_rows in (0, 1000):
        got = mixing.mix(docs, weights=(1, 1), broadcast_rows=broadcast_rows).collect()
        taken = {s: sum(r.taken for r in got if r.source == s) for s in "ab"}
        assert len(got) == len(rows) and abs(taken["a"] - 1650) <= 3 and taken["b"] == 1650


def test_shards_of_ids_that_are_no_numbers(spark):
    rows = [(f"doc{k % 40}" if k % 9 else None, f"text {k}") for k in range(200)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id string, text string"), 5).collect()
    of = {}
    for r in got:
        of.setdefault(r.doc_id, set()).add((r.shard, r.grown_shard))
    assert len(got) == 200 and all(len(x) == 1 for x in of.values()) and all(g in (s, 5) for ((s, g),) in of.values())
    assert len({s for ((s, _),) in of.values()}) == 5


def test_many_sources_are_summed_by_ranges(spark):
    sizes = {f"h{k}": k * k % 97 for k in range(300)} | {None: 40}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    kept = mixing.running_sums
    try:
        mixing.running_sums = lambda *a, **k: kept(*a, **k, one_task_rows=0)
        got = {r.source: r.target for r in mixing.targets(frame.repartition(5)).collect()}
    finally:
        mixing.running_sums = kept
    assert all(abs(got[s] - x) < 1e-6 for s, x in plain_targets(sizes).items())


def test_running_sums_by_key(spark):
    rows = [(k % 3 if k % 5 else None, k // 4, k) for k in range(200)] + [(7, 1, 1)] * 50
    frame = spark.createDataFrame(rows, "k int, o int, v int").repartition(3)
    for few in (0, 1000):
        got = running_sums(frame, [F.col("o"), F.col("v")], {"n": F.lit(1), "s": F.col("v")}, by=("k",), one_task_rows=few).collect()
        for key in (0, 1, 2, None, 7):
            n = s = 0
            for r in sorted((r for r in got if r.k == key), key=lambda r: (r.o, r.v, r.n)):
                assert (r.n, r.s) == (n, s)
                n, s = n + 1, s + r.v
            assert n == sum(x[0] == key for x in rows)


def test_join_with_hot_keys(spark, tmp_path):
    spark.createDataFrame([(None if k % 50 == 0 else f"k{k % 40}" if k % 3 else "hot", k) for k in range(1000)], "k string, v int").write.parquet(f"{tmp_path}/l")
    spark.createDataFrame([(f"k{k}", k) for k in range(30)] + [("hot", -1), (None, 5)], "k string, w int").write.parquet(f"{tmp_path}/r")
    left, right = spark.read.parquet(f"{tmp_path}/l"), spark.read.parquet(f"{tmp_path}/r")
    plain = sorted(map(tuple, left.join(right, "k").collect()))
    for rows in (0, 1000):
        assert sorted(map(tuple, join_unique(left, right, "k", rows=rows, hot_rows=100).collect())) == plain
    right = right.where("k is not null")
    for side in (right, right.where("k <> 'hot'"), right.limit(0)):
        plain = sorted(map(repr, left.join(side, "k", "left").collect()))
        for rows in (0, 1000):
            assert sorted(map(repr, left_join_unique(left, side, "k", rows=rows, hot_rows=100).collect())) == plain
        # Hot and null keys are in no shuffle.
        plan = left_join_unique(left, side, "k", rows=0, hot_rows=100)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Join") <= 4
    structs = [F.struct(F.lit(None).cast("int").alias("i"), F.col("k")).alias("s")]
    both = left_join_unique(left.select("v", *structs), right.select("w", *structs), "s", rows=0, hot_rows=100)
    assert both.where("w is not null").count() == left.join(right, "k").count() and both.count() == left.count()


def test_mix_query(spark):
    assert check(spark, registry.op10_mixing, registry.ORACLE_SQL["op10_mixing"]) == 200


RULES = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    out = []
    for k, (name, rule) in enumerate(RULES):
        for m in re.finditer(rule, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": name != "ip" or all(int(x) < 256 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[name]:
                out.append((m.start(), k, m.end(), name))
    return sorted(out)


ODD = [None, "", "a@b.c@d.e_x@f.g", "𝄞 mail x.y+z@host-1.example.com, 1.2.3.4.5.6.7.8 999.1.1.1 007.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111111", "+1 (017) 555-7713 +49.30.123456 ++1 2", "1" * 30_000, "a" * 30_000 + "@" + "b" * 30_000, "1.2.3.4@5.6.7.8", "@@..@a.b", "+1 " + "( " * 5000]


def test_rules_against_plain_expressions(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate([*ODD, *ODD[:4]])], "doc_id long, text string, found string")
    got = pii.personal_data(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert [tuple(s) for s in r.found] == plain_spans(([*ODD, *ODD[:4]])[r.doc_id]), r.doc_id
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_query_against_plain_expressions(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for r in registry.op9_personal_data(spark, SF_DIR).collect():
        spans = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == sha256(",".join(f"{n}:{a}:{e}" for a, _, e, n in spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[3] == n for s in spans) for n, _ in RULES]
        assert all(f"{n}:{a}:{e}" in r.spans.split(",") for a, _, e, n in spans)


def test_contexts_of_seeds_find_other_identifiers(spark):
    seeds = [(k, f"please call my number +1 (21{k % 10}) 555-{1000 + k} today and order item 77-{k}-8888 there") for k in range(20)]
    docs = spark.createDataFrame([*seeds, (90, "please call my number 0049-177-5550 today"), (91, "see page 12345678 here")], "doc_id long, text string")
    found = {r.doc_id: [(s.kind, s.start) for s in r.found] for r in pii.personal_data(docs).collect()}
    assert found[90] == [("id", 22)] and found[91] == [] and found[3] == [("phone", 22)]


#: Contexts of 60 seeds each, and the form of the identifiers no rule knows that stand in them.
CONTEXTS = {"email": ("write to me at {} please", "u{0}@intranet"), "ip": ("logged in from {} again", "fe80.{0:04d}.x"), "card": ("paid by card {} in full", "CARD-{0:05d}"), "phone": ("call my number {} today", "0049-{0:05d}")}
SEED = {"email": "name{0}@mail.example.com", "ip": "10.1.7.{0}", "card": "4111 1111 1111 {0}", "phone": "+1 (212) 555-{0:04d}"}
HOP = "customer record {} was opened"


def planted_identifiers(rng):
    """(documents, {doc_id: identifier}) of first contexts, of a second one that only identifiers of the first share,
    and of neither."""
    docs, first, second, decoys = [], {}, {}, {}
    for kind, (context, form) in CONTEXTS.items():
        plain = lambda k: f"4111 1111 1111 {next(c for c in range(1000 * (k % 9 + 1) + 10 * k, 9999) if plain_spans(f'4111 1111 1111 {c}'))}" if kind == "card" else SEED[kind].format(k)  # noqa: B023, E731
        docs += [(len(docs) + k, f"{context.format(plain(k))} and w{rng.random()}") for k in range(60)]
        for k in range(20):
            first[len(docs)] = form.format(k)
            docs.append((len(docs), f"{'long' * 40} {context.format(form.format(k))} and so on"))
    for k in range(12):
        docs.append((len(docs), HOP.format(CONTEXTS["phone"][1].format(k))))
    for k in range(8):
        second[len(docs)] = f"KX{k}77-{k}123"
        docs.append((len(docs), HOP.format(second[len(docs)])))
    for k in range(40):
        decoys[len(docs)] = f"{k}00-PART-{k}"
        docs.append((len(docs), f"order part {decoys[len(docs)]} from stock"))
    return docs, first, second, decoys


def test_recall_of_identifiers_in_contexts_of_seeds_and_of_identifiers(spark):
    docs, first, second, decoys = planted_identifiers(np.random.default_rng(3))
    text = dict(docs)
    got = {r.doc_id: [text[r.doc_id][s.start : s.end] for s in r.found if s.kind == "id"] for r in pii.personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for expected in (first, second):
        assert sum(v in got[i] for i, v in expected.items()) >= 0.9 * len(expected)
    assert not any(v in got[i] for i, v in decoys.items())
    # One round finds the first only.
    once = {r.doc_id: len(r.found) for r in pii.personal_data(spark.createDataFrame(docs, "doc_id long, text string"), rounds=1).collect()}
    assert all(once[i] for i in first) and not any(once[i] for i in second)


def test_keys_are_found_in_contexts_of_keys_only(spark):
    sha = lambda k: hashlib.sha1(str(k).encode()).hexdigest()
    docs = [(k, f'the token = "{sha(k)}" of w{k}') for k in range(9)] + [(20, f"x{sha(77)} {sha(20)} alone"), (21, "")] + [(30 + k, f'my token = "{sha(k)}A{"9" * 90}"') for k in range(2)]
    got = {r.doc_id: [s.kind for s in r.found] for r in pii.personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[k] == ["id"] for k in [*range(9), 30, 31]) and got[20] == got[21] == []


def test_words_that_mostly_stand_alone_make_no_pattern(spark):
    """Seeds behind an article, which is everywhere, and behind a phrase of their own."""
    rng = np.random.default_rng(5)
    filler = lambda: " ".join("the " + "".join(rng.choice(list("abcdefgh"), 6)) for _ in range(30))
    docs = [(k, f"{filler()} the u{k}@mail.example.com {filler()} reach us under +1 (212) 555-{1000 + k} {filler()}") for k in range(40)]
    docs += [(100, f"{filler()} the 2362971821055609 {filler()}"), (101, f"{filler()} reach us under 0049-555-1234 {filler()}")]
    for broadcast_rows in (0, 1000):
        got = {r.doc_id: [s.kind for s in r.found] for r in pii.personal_data(spark.createDataFrame(docs, "doc_id long, text string"), broadcast_rows=broadcast_rows).collect()}
        assert got[100] == [] and got[101] == ["id"] and got[0] == ["email", "phone"]


def test_secrets_of_the_documents(spark):
    sf = "/root/testdata/sf0.01"
    for r in spark.read.parquet(f"{sf}/documents.parquet").join(registry.op9_personal_data(spark, sf), "doc_id").where("text like '%token = %'").collect():
        for m in re.finditer(r'token = "([0-9a-f]{40})"', r.text):
            assert f"id:{m.start(1)}:{m.end(1)}" in r.spans.split(",")


def handles(rng):
    """(documents, identifiers by document, documents without any) of forms that no rule and no digit gives away."""
    docs, expected, clean = [], {}, []
    add = lambda text: docs.append((len(docs), text)) or len(docs) - 1
    letters = lambda n: "".join(rng.choice(list("bcdfghklmnprstvz"), n))
    for k in range(60):
        add(f"signed in as n{k}.{letters(5)}@mail.example.com today after a break {letters(4)}")
        add(f'the caller id: "+1 (212) 555-{1000 + k}" was written down {letters(4)}')
    for k in range(25):
        handle = f"{letters(5)}_{letters(4)}" if k % 2 else f"{letters(4)}{letters(4).upper()}"
        expected[add(f"signed in as {handle} today and stayed")] = handle
        account = f"{letters(4)}-{letters(4)}/{letters(2)}"
        expected[add(f'the caller id: "{account}", was new')] = account
    # A common word may stand there once; it is no identifier, and neither is what stands in contexts of their own.
    common = add("signed in as administrator today without a badge")
    for k in range(30):
        clean.append(add(f"every administrator reads page {letters(6)} of the manual {letters(5)}"))
        clean.append(add(f"flown in on {letters(7)} with luggage {k}{letters(6)}"))
    return docs, expected, [common, *clean]


def test_identifiers_of_any_form(spark):
    docs, expected, clean = handles(np.random.default_rng(8))
    text = dict(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    # Texts that stand there several times, and rows in another order, change nothing.
    for df, literals in ((frame.repartition(7), pii.LITERALS), (frame.union(frame.where("doc_id % 3 = 0")), 0)):
        got = {r.doc_id: [text[r.doc_id][s.start : s.end] for s in r.found if s.kind == "id"] for r in pii.personal_data(df, literals=literals, broadcast_rows=0 if literals == 0 else 1000).collect()}
        assert sum(v in got[i] for i, v in expected.items()) >= 0.9 * len(expected)
        assert not any(got[i] for i in clean)


def test_no_seed_no_search(spark):
    docs = spark.createDataFrame([(1, "nothing here"), (2, None), (3, "mail a@b.example once")], "doc_id long, text string")
    assert {r.doc_id: [s.kind for s in r.found] for r in pii.personal_data(docs).collect()} == {1: [], 2: [], 3: ["email"]}
