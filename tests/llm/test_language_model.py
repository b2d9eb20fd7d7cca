"""The Katz model against one in plain Python, its sums, odd rows and plans that must not change results."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import language_model, registry
from millrace.llm.common import table
from tests.oracle import SF_DIR

DOCS = "doc_id long, text string, learn boolean"


def _tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


class _Katz:
    """From the textbook; a history or a vocabulary that discounting takes nothing from is counted once more."""

    def __init__(self, learned):
        self.uni, self.bi = Counter(), defaultdict(Counter)
        for text in learned:
            before = "<start>"
            for w in _tokens(text):
                self.uni[w] += 1
                self.bi[before][w] += 1
                before = w
        times = lambda xs: [sum(x == r for x in xs) for r in range(1, 7)]
        self.d1 = language_model.discounts(times(self.uni.values()))
        self.d2 = language_model.discounts(times([n for b in self.bi.values() for n in b.values()]))
        self.total = sum(self.uni.values())
        self.lost = sum(n - self.kept(n, self.d1) for n in self.uni.values())
        self.weights = {}
        for h, b in self.bi.items():
            lost = sum(n - self.kept(n, self.d2) for n in b.values())
            total = sum(b.values()) + (lost < 1e-9)
            self.weights[h] = (total, (1 - sum(self.kept(n, self.d2) for n in b.values()) / total) / (1 - sum(map(self.unigram, b))))

    @staticmethod
    def kept(n, ratios):
        return n * (ratios[n - 1] if n <= len(ratios) else 1)

    def unigram(self, w):
        total = self.total + (self.lost < 1e-9)
        return (self.kept(self.uni[w], self.d1) if w in self.uni else self.lost if self.lost > 1e-9 else 1) / total

    def p(self, w, h):
        if w in self.bi.get(h, {}):
            return self.kept(self.bi[h][w], self.d2) / self.weights[h][0]
        return self.weights.get(h, (0, 1.0))[1] * self.unigram(w)

    def row(self, text):
        tokens = _tokens(text)
        base = sum(math.log10((self.uni[w] + 1) / (self.total + len(self.uni) + 1)) for w in tokens)
        return len(tokens), sum(w in self.uni for w in tokens), base, sum(math.log10(self.p(w, h)) for h, w in zip(["<start>", *tokens], tokens, strict=False))


def _same(got, expected):
    assert len(got) == len(expected)
    for a, b in zip(sorted(got), sorted(expected), strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], abs=1e-6), (a, b)


@pytest.fixture(scope="module")
def docs():
    rnd = random.Random(12)
    words = ["a", "B", "the", "of", "x1", "ß", "É", "zz", *[f"w{i}" for i in range(60)]]
    text = lambda: rnd.choice([" ", "\n", "  "]).join(words[min(len(words) - 1, int(rnd.expovariate(0.12)))] for _ in range(rnd.choice([0, 1, 3, 10, 40])))
    rows = [(i if i != 5 else -1, text() if i % 17 else None, rnd.random() < 0.7) for i in range(200)]
    rows += [(500 + i, "fixed phrase always here fixed phrase always", True) for i in range(9)] + [(500, "fixed phrase always here fixed phrase always", True)]
    return [*rows, (600, "fixed phrase again fixed nothing unknownword phrase zz here the", False), (601, "the " * 3000, False)]


@pytest.mark.parametrize("plan", [{}, {"block": 50, "part_bytes": 700}, {"block": 70, "part_bytes": 900, "hot": [language_model.END, 12345, *language_model._hashed([b"the", b"fixed"]).tolist()]}])
def test_scores_against_plain_katz(spark, monkeypatch, docs, plan):
    if plan:
        # Taken from here by the tasks.
        monkeypatch.setattr(language_model, "SEGMENT", 30)
        monkeypatch.setattr(language_model, "HELD_SUMS", 20)
    katz = _Katz([t for _, t, learn in docs if learn])
    assert any(sum(n - katz.kept(n, katz.d2) for n in b.values()) < 1e-9 for b in katz.bi.values())
    df = spark.createDataFrame(docs, DOCS).withColumn("score", F.lit("extra"))
    model = language_model.fit(df, F.col("learn"), **plan)
    assert (model.stats.tokens, model.stats.words) == (katz.total, len(katz.uni))
    out = language_model.score(model, broadcast_rows=0 if plan else 100_000)
    _same([tuple(r)[:1] + tuple(r)[2:] for r in out.collect()], [(i, *katz.row(t)) for i, t, _ in docs])
    backoffs = {r.history: r for r in model.backoffs.collect()}
    assert len(backoffs) == len(katz.bi)
    for h, b in katz.bi.items():
        assert sum(katz.p(w, h) for w in {*katz.uni, "unknown"}) == pytest.approx(1, abs=1e-9), (h, b)


def test_pieces_are_the_words_of_a_text():
    text = (b"One two\x0bthree \xc3\x89t\xc3\xa9 " * 50 + b"x" * 1000 + b"\n\n tail").lower()
    for size in (1, 7, 100, 10_000):
        assert [w for words in language_model._pieces(text, size) for w in words] == text.split()
    assert max(len(words) for words in language_model._pieces(text, 7)) <= 4


def test_discounts():
    counts = [1000, 400, 240, 165, 125, 100]
    found = language_model.discounts(counts)
    assert len(found) == 5 and all(0 < d < 1 for d in found)
    # What the counts up to five lose is what Good and Turing give the unseen: the number of those seen once.
    assert sum(n * (r + 1) * (1 - d) for r, (n, d) in enumerate(zip(counts, found, strict=False))) == pytest.approx(1000)
    assert language_model.discounts([5, 0, 3, 0, 0, 0]) == [0.5, 0.75, 2.5 / 3, 0.875, 0.9]


def test_odd_rows(spark):
    for rows, learn in (([], []), ([(1, "a b", False), (2, None, False)], []), ([(1, "a a", True), (1, "a a", True), (None, "", False)], ["a a", "a a"])):
        model = language_model.fit(spark.createDataFrame(rows, DOCS), F.col("learn"))
        got = [(-1 if r.id is None else r.id, *tuple(r)[2:]) for r in language_model.score(model).collect()]
        if learn:
            katz = _Katz(learn)
            _same(got, [(-1 if i is None else i, *katz.row(t)) for i, t, _ in rows])
        else:
            _same(got, [(i, len(_tokens(t)), 0, 0.0, 0.0) for i, t, _ in rows])


def test_query_against_plain_katz(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF_DIR, "documents").select("doc_id", "text").collect()]
    katz = _Katz([t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2])
    got = registry.QUERIES["op12_katz_model"](spark, SF_DIR).collect()
    assert {r.train_tokens for r in got} == {katz.total}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)
    _same([(r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got], [(i, *katz.row(t)) for i, t in rows])
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
