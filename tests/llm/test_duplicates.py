import random

import pytest
import xxhash

from millrace.llm import simhash as sh
from millrace.llm.graph import connected_components
from tests.oracle import SF_DIR


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    g = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, radius=3):
    """id -> smallest id reachable, over all pairs."""
    ids, root = list(prints), {i: i for i in prints}
    find = lambda i: i if root[i] == i else find(root[i])
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_every_pair_within_the_radius_meets():
    rng = random.Random(1)
    for positions in (list(range(64)), list(range(0, 64, 2))):
        masks = sh.covering_masks(positions)
        for _ in range(3000):
            gone = sum(1 << p for p in rng.sample(positions, rng.randint(1, 3)))
            assert any(not m & gone for m in masks)


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_documents_against_all_pairs(spark, broadcast_rows):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    got = sh.near_duplicates(docs, broadcast_rows=broadcast_rows).collect()
    assert {r.doc_id: r.fp % 2**64 for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == components(prints)


def test_close_fingerprints_in_full_buckets(spark):
    """With a cap of 4 nearly every bucket is split again; chains and the result stay the same."""
    rng, prints = random.Random(3), {}
    for start in (0, 2**63, 0x0123456789ABCDEF):
        at = start
        for _ in range(60):
            prints[len(prints)] = at
            at ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 5])))
    rows = spark.createDataFrame([(sh._signed(p),) for p in set(prints.values())], "fp long")
    for cap in (4, 256):
        roots = {r.node % 2**64: r.root % 2**64 for r in connected_components(sh.near_links(rows, cap=cap)).collect()}
        mine = components(prints)
        same = lambda of: {frozenset(k for k, p in prints.items() if of(k, p) == v) for v in {of(k, p) for k, p in prints.items()}}
        assert same(lambda k, p: roots.get(p, p)) == same(lambda k, p: mine[k])


def test_nulls_empty_texts_and_repeats(spark):
    rows = [(5, None, "x"), (3, "", "x"), (4, " \n", "x"), (9, "A b", "x"), (8, "a\tB", "x"), (8, "a b", "x"), (None, "a b", "x"), (None, "other words here", "x")]
    got = sh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, root string")).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got if r.component_id is not None) == [(-1, 8), (3, 3), (4, 3), (5, 3), (8, 8), (8, 8), (9, 8)]
    assert [r.doc_id for r in got if r.component_id is None] == [None]
    assert sh.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(100)] + [(5, 5), (None, 1)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(100)}


@pytest.mark.parametrize("rows", [0, 1000])
def test_components_with_hot_centres(spark, rows):
    """Stars around the least, a middle and the largest node, linked by one edge each; nodes of over 20 edges are hot."""
    rng = random.Random(8)
    edges = [(c, n) for c, nodes in ((0, range(1, 300)), (500, range(301, 700)), (1999, range(1000, 1500))) for n in nodes] + [(7, 301), (650, 1400), (3000, 3001)]
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges] + edges[:50]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7), rows=rows, hot_rows=20).collect()}
    assert got == {n: 3000 if n >= 3000 else 0 for e in edges for n in e}
    assert connected_components(spark.createDataFrame([], "a long, b long"), rows=rows).count() == 0
