"""Conversation repair and spelling variants: SQL, brute force, odd rows."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import registry, repair, spelling
from millrace.llm.common import table
from tests import oracle

TURNS = "conv_id long, turn long, role string, text string"
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op13_spelling_variants"])
def test_query_against_sql(spark, name):
    assert oracle.check(spark, registry.QUERIES[name], registry.ORACLE_SQL[name]) > 0


def _cheapest(turns):
    """By Dijkstra's search over audits: (digest columns) of one conversation's (turn, role, text)."""
    turns = sorted(((t, r or "", x or "") for t, r, x in turns), key=lambda q: (q[0] is not None, q[0] or 0, q[1], q[2]))
    seen, faults = set(), []
    for _, r, x in turns:
        bare = x.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else "none")
        seen.add((r, x))
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, s, out = heapq.heappop(heap)
        if i == len(turns) and s in (0, 3):
            break
        if (i, s) in done:
            continue
        done.add((i, s))
        new = "user" if NEXT[s] == 2 else "assistant"
        heapq.heappush(heap, (cost + 3, audit + "I", i, NEXT[s], (*out, (new, ""))))
        if i == len(turns):
            continue
        _, r, x = turns[i]
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, s, out))
        if faults[i] not in ("blank", "duplicate"):
            more = 3 * (faults[i] == "truncated")
            to = 1 if r[:1] == "s" and s == 0 else NEXT[s] if r[:1] == "??us"[NEXT[s]].replace("s", "a") else None
            if to:
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, to, (*out, (r, x))))
            heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, NEXT[s], (*out, (new, x))))
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    text = "\n".join(f"{r}:{x}" for r, x in out)
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest(), out)


@pytest.mark.parametrize(("chunk", "one_task_rows"), [(4096, None), (3, 0)])
def test_repair_is_cheapest_and_least(spark, chunk, one_task_rows):
    rnd = random.Random(11)
    rows = []
    for c in range(60):
        for t in range(rnd.randint(0, 7) if c else 50):
            role = rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
            rows.append((None if c == 3 else c, rnd.choice([t, t, t, t - 1, None]), role, rnd.choice(["Hi.", "ok", "what? ", "  ", None, "yes!", "no", "ä b."])))
    of = {}
    for c, *turn in rows:
        of.setdefault(c, []).append(turn)
    expected = {c: _cheapest(turns) for c, turns in of.items()}
    edited = repair.repair(spark.createDataFrame(rows, TURNS).withColumn("place", F.lit("extra")), chunk, one_task_rows)
    got = {r[0]: tuple(r)[1:] for r in repair.digests(edited).collect()}
    assert got == {c: e[:-1] for c, e in expected.items()}
    new = {}
    for r in repair.repaired(edited).orderBy("place", "step").collect():
        new.setdefault(r.conv_id, []).append((r.role, r.text))
    assert new == {c: list(e[-1]) for c, e in expected.items() if e[-1]}


def test_a_conversation_of_most_rows_is_cut(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"t{i % 5000}.") for i in range(9_000)] + [(c, 0, "user", "x.") for c in range(2, 300)]
    edited = repair.repair(spark.createDataFrame(rows, TURNS), 64, 500)
    got = {r[0]: r for r in repair.digests(edited).collect()}
    assert got[1].duplicate == 4_000 and got[2].audit == "KI" and len(got) == 299
    # An assistant's turn comes first and a user's last: cheaper than to delete them are turns before and behind.
    assert got[1].audit == "I" + "K" * 5_000 + "D" * 4_000 + "I" and got[1].cost == 2 * 3 + 4 * 4_000


def test_damage_by_rule(spark):
    rows = [(c, t, "user", "A. b! c?") for c in range(40) for t in (0, 1, None)] + [(None, None, None, None)]
    out = Counter()
    for r in repair.damage(spark.createDataFrame(rows, TURNS)).collect():
        out[(r.conv_id, r.turn, r.role, r.text)] += 1
    expected = Counter()
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if kind:
            expected[(c, t, "user" if kind == 4 else r, "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x)] += 1 + (kind == 3)
    assert out == expected
    assert repair.digests(repair.repair(repair.damage(spark.createDataFrame([], TURNS)))).count() == 0


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(count):
    kept = {w: n for w, n in count.items() if n >= 5}
    out = {}
    for w, n in kept.items():
        near = [v for v in kept if v != w and abs(len(v) - len(w)) < 2 and _near(w, v)]
        form = min(near, key=lambda v: (-kept[v], v), default=None)
        out[w] = [form if form is not None and kept[form] >= 5 * n else None, w, n, len(near), None]
    for w, row in out.items():
        while out[row[1]][0] is not None:
            row[1] = out[row[1]][0]
        row[4] = None if row[0] is None else kept[row[0]]
    return {w: tuple(row) for w, row in out.items()}


@pytest.fixture(scope="module")
def words():
    rnd = random.Random(13)
    out = Counter({"ab" * 50: 40, "ab" * 15 + "q" + "ab" * 34 + "a": 6, "ab" * 50 + "z": 5, "b" + "ab" * 49: 8, "x" * 70: 5, "x" * 71: 30, "y" * 64: 5, "y" * 65: 26, "y" * 66: 200, "m" * 30_000: 5, "m" * 29_999 + "n": 25})
    for _ in range(300):
        out["".join(rnd.choice("abé\U0001f600") for _ in range(rnd.randint(0, 5)))] += rnd.choice([1, 5, 7, 25, 30, 150, 800])
    return out


def test_variants_against_brute_force(spark, words):
    df = spark.createDataFrame(list(words.items()), "word string, n long").select("word", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k"))
    df = df.drop("k").unionByName(spark.createDataFrame([(None,)] * 9, "word string"))
    got = {r[0]: tuple(r)[1:] for r in spelling.group_variants(df.withColumn("n", F.lit(3))).collect()}
    assert got == _variants(words)


def test_words_whose_hashes_collide_are_told_apart():
    count = {"abcd": 100, "abce": 5, "xbcd": 7, "abcde": 9, "zzzz": 50, "zzzzz": 6, "q": 5}
    rows = sorted((len(w) - (at >= 0), at, w, n) for w, n in count.items() for at in range(-1, len(w)))
    key, at, word, n = zip(*rows, strict=True)
    near, forms = Counter(), {}
    for w, k, form, form_n in zip(*spelling._told(np.array(key), np.array(at), list(word), np.array(n), 5), strict=True):
        near[w] += k
        if form is not None:
            forms[w] = min(forms.get(w, (0, "")), (-form_n, form))
    expected = _variants(count)
    assert {w: near[w] for w in count} == {w: e[3] for w, e in expected.items()}
    assert {w: f for w, (_, f) in forms.items()} == {w: e[0] for w, e in expected.items() if e[0] is not None}


def test_variants_of_nothing(spark):
    assert spelling.group_variants(spark.createDataFrame([], "word string")).count() == 0


def test_runs_and_misspellings(spark):
    texts = [(1, "Straße ÉTÉS naïveté×÷ x1abcdefg"), (None, "Hello hello"), (2, None), (3, ""), (4, "Z" * 50_000 + " " + "wordy " * 500)]
    got = Counter(r[0] for r in spelling.misspelt_words(spark.createDataFrame(texts, "doc_id long, text string"), 1, 3).collect())
    expected = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            expected[run if h % 3 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    expected.pop("", None)
    assert got == expected


def test_variants_of_documents(spark):
    docs = table(spark, oracle.SF_DIR, "documents").select("doc_id", "text")
    count = Counter(r[0] for r in spelling.misspelt_words(docs, 6, 7).collect())
    got = {r[0]: tuple(r)[1:] for r in spelling.group_variants(spelling.misspelt_words(docs, 6, 7)).collect()}
    assert got == _variants(count) and sum(r[0] is not None for r in got.values()) > 0
