import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
import zstandard

from millrace.llm import compression_classifier as cc
from millrace.llm import quality_rules as qr
from millrace.llm import registry
from tests.oracle import SF_DIR

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \t\n", "a", "a b a b a b", "x\x0by\x0cz\r\nx y\n\nx y\n", "#*$ é|é & <𝄞>", "w " * 60, "a b c d " * 300, "p q r s t u " * 30 + "\n" + " ".join(map(str, range(400)))]


def base(text):
    t = text or ""
    w = WORD.findall(t)
    runs = list(zip(w, w[1:], w[2:], strict=False))
    n, covered = Counter(runs), set()
    for i, g in enumerate(runs):
        covered |= {i, i + 1, i + 2} if n[g] > 1 else set()
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed


def test_counts_match_brute_force(spark):
    rows = [(i, t, "x", 1.0) for i, t in enumerate(ODD)] + [(1, "", "x", 1.0), (None, "one two", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, KEPT string, llr double").repartition(3)
    got = qr.quality_rules(docs, [0.0] * 8).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(r.text), r.text
        assert r.kept == (not r.base_failed)
    assert qr.quality_rules(docs.limit(0), [0.0] * 8).count() == 0


def test_ratios_do_not_depend_on_the_way_of_joining(spark):
    docs = spark.createDataFrame([(i, f"good words here {i}" if i % 2 else f"BAD!! WORDS!! {i}") for i in range(40)] + [(None, "x"), (7, None)], "doc_id long, text string")
    trusted = spark.createDataFrame([(i,) for i in range(1, 40, 2)] + [(1,), (None,)], "doc_id long")
    ratios = qr.ngram_log_ratios(docs, trusted, buckets=256)
    assert ratios == qr.ngram_log_ratios(docs, trusted, buckets=256, broadcast_rows=0)
    hot = docs.union(spark.createDataFrame([(5, f"hot id {i}") for i in range(60)] + [(None, f"null id {i}") for i in range(60)] + [(1000, "hot, not trusted")] * 60, docs.schema))
    assert qr.ngram_log_ratios(hot, trusted, buckets=256) == qr.ngram_log_ratios(hot, trusted, buckets=256, broadcast_rows=0, hot_rows=20)
    llr = {r.doc_id: r.llr for r in qr.quality_rules(docs.where("text is not null"), ratios).collect()}
    assert min(llr[i] for i in range(1, 40, 2)) > max(llr[i] for i in range(0, 40, 2))
    assert set(qr.ngram_log_ratios(docs, trusted.limit(0), buckets=16)) == {0.0}


def test_verdicts_against_brute_force(spark):
    """Counts, ratios, scores and verdicts of all documents, from the definitions."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    labels = {}
    for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect():
        labels.setdefault(r.doc_id, set()).add(r.quality)
    signed = lambda h: h - (1 << 64) if h >> 63 else h

    def buckets(text):
        h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in WORD.findall(text or "")]
        pack = lambda x: x.to_bytes(8, "little", signed=True)
        first = [xxhash.xxh64_intdigest(pack(a), 42) for a in h]
        pairs = [signed(xxhash.xxh64_intdigest(pack(b), a)) for a, b in zip(first, h[1:], strict=False)]
        # The last word is paired with the end of the text, of which there is nothing to hash.
        return [x % qr.BUCKETS for x in [*h, *pairs, *(signed(x) for x in first[-1:])]]

    grams = {i: buckets(t) for i, t in docs.items()}
    raw, target = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        target.update(g if labels.get(i) == {1} else ())
    n_raw, n_target, added = sum(raw.values()), sum(target.values()), 16 * qr.BUCKETS
    ratio = {b: round(math.log((target[b] / (raw[b] / n_raw) + added) / (n_target + added)), 5) for b in raw}
    for r in registry.op1_quality_rules(spark, SF_DIR).collect():
        g = grams[r.doc_id]
        llr = sum(ratio[b] for b in g) / len(g) if g else 0.0
        assert abs(r.llr - llr) < 1e-5, r.doc_id
        assert r.base_failed == base(docs[r.doc_id])[-1]
        assert abs(llr - qr.THRESHOLD) < 1e-4 or r.kept == (not r.base_failed and llr >= qr.THRESHOLD)


def test_good_documents_are_kept(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    got = registry.op1_quality_rules(spark, SF_DIR).collect()
    assert all(r.kept or r.base_failed for r in got if labels.get(r.doc_id) == 1)


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = registry.op3_compression_classifier(spark, sf).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


def test_scores_against_plain_compression(spark):
    """Dictionaries of the model, everything else written anew: blocks of 512 bytes, the sizes' difference, the curve."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, "é" * 700), (-4, "x" * 100_000)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    model = cc.train(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet").where(~registry.held_out()))

    def size(data, dictionary):
        zstd = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_dict_id=False)
        return sum(len(zstd.compress(data[k : k + 512])) for k in range(0, len(data), 512))

    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in cc.score(docs, model).collect():
        data = texts[r.doc_id]
        at = model.intercept + (model.slope * (size(data, model.bad) - size(data, model.good)) + model.length * len(data)) / (len(data) + model.evidence)
        assert abs(r.score - 1 / (1 + math.exp(-max(-30, min(30, at))))) < 1e-9 and r.predicted == (r.score >= 0.7), r.doc_id


def test_evidence_is_chosen_by_the_curves_texts_alone():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400)
    n = rng.integers(10, 3000, 400)
    measured = np.c_[rng.normal((2 * y - 1) * n * 0.05, 20), n].astype(float)
    chosen = cc._choose_evidence(measured, y.astype(float))
    losses = {}
    for e in cc.EVIDENCE:
        total, part = 0.0, np.empty(400, int)
        for c in (0, 1):
            part[y == c] = np.arange((y == c).sum()) % 5
        for k in range(5):
            a, b, c = cc._fit_curve(cc._normalised(measured[part != k], e), y[part != k].astype(float))
            for (d, m), t in zip(measured[part == k], y[part == k], strict=True):
                p = 1 / (1 + math.exp(-max(-30, min(30, a + b * d / (m + e) + c * m / (m + e)))))
                total -= math.log(p if t else 1 - p)
        losses[e] = total
    assert chosen == min(losses, key=losses.get)
    assert cc._choose_evidence(measured[:30], np.r_[np.ones(25), np.zeros(5)]) == cc.DEFAULT_EVIDENCE


@pytest.mark.parametrize("labelled", [[], [(1, 1)], [(1, 1), (2, 0), (2, 1), (None, 1), (3, None)]])
def test_classifier_with_hardly_any_labels(spark, labelled):
    docs = spark.createDataFrame([(1, "a b", 5), (2, None, 5), (2, None, 5), (None, "", 5)], "doc_id long, text string, score int")
    model = cc.train(docs, spark.createDataFrame(labelled, "doc_id long, quality int"))
    got = cc.score(docs, model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert cc.score(docs.limit(0), model).count() == 0


def test_dictionaries_learn_from_whole_texts_within_a_byte_budget(spark):
    """What sets the classes apart stands behind 20,000 bytes of words that they share."""
    rng = random.Random(1)
    shared = lambda: " ".join(f"s{rng.randrange(3000)}" for _ in range(4000))
    words = lambda kind, k: " ".join(f"{kind}{(k * 7 + j) % 50}" for j in range(100))
    rows = [(i, shared() + " " + words("good" if i % 2 else "bad", i)) for i in range(120)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    model = cc.train(docs, labels)
    assert b"good1" in model.good and b"bad1" in model.bad and b"bad1" not in model.good and b"good1" not in model.bad
    one = cc.train(docs, labels, sample=cc.Sample(dictionary_bytes=30_000))  # a single text of each class fits
    assert b"good1" in one.good and b"bad1" in one.bad
    assert cc.train(docs, labels, sample=cc.Sample(dictionary_bytes=100)).good == b""


def test_orders_within_the_bytes():
    row = lambda y, order, n: {"_y": y, "_order": order, "_n": n}
    rows = [row(0, 1, 5), row(1, 1, 9), row(0, 2, 3), row(0, 2, 3), row(1, 3, 1), row(1, 4, 1)]
    assert cc._last_orders(rows, 10) == {0: 1, 1: 3}
    assert cc._last_orders(rows, 11) == {0: 2, 1: 4}
    assert cc._last_orders(rows, 4) == {}
