"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position gets a non-zero vector of radius + 1 bits; table v keeps the positions whose vector has an odd
product with v. Two fingerprints that differ in at most `radius` positions give at most radius equations in radius + 1
unknowns, so some non-zero v vanishes on all of them: in that table the pair has the same key. No pair within the
radius is missed, and each key keeps about half of the bits.

Only distinct fingerprints are compared. A bucket with more than `cap` of them is split again by the same construction
over the bits that its key leaves out, which loses no pair and leaves at most 2^16 fingerprints in a bucket. A bucket
yields a spanning forest, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import extras_apart, join_unique, materialize
from millrace.llm.graph import connected_components

RADIUS = 3
SEED = 42
SHINGLE = 3
#: Distinct fingerprints in a bucket before it is split again.
CAP = 256
#: Joins by fingerprint broadcast so many rows at most: both sides grow alike, and are narrow.
NARROW_ROWS = 100_000
_CHUNK = 1 << 16


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """2^(radius + 1) - 1 masks over these bit positions; any `radius` positions are all left out by some mask."""
    vectors = (1 << radius + 1) - 1
    of = {p: 1 + k * 7 % vectors for k, p in enumerate(positions)}
    return [sum(1 << p for p, m in of.items() if (m & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a whole UTF-8 text; 0 without a word."""
    found = text.lower().split()
    if not found:
        return 0
    joined, size = b" ".join(found), len(found)
    ends = list(accumulate((len(w) + 1 for w in found), initial=0))
    last = max(1, size - shingle + 1)
    set_in, h = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, last, _CHUNK):
        to = min(last, at + _CHUNK)
        hashes = np.array([h(joined[s : e - 1], SEED) for s, e in zip(ends[at:to], ends[min(at + shingle, size) :], strict=False)], np.uint64)
        set_in += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > last, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with text_col replaced by `fp`, the signed fingerprint of the whole text. A null text counts as empty."""
    rest = [c for c in docs.columns if c not in (text_col, "fp")]
    out = docs.select(*rest).schema.add("fp", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(rest)).cast(pa.binary())
            fp = pa.array([fingerprint(x.as_py() or b"") for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], fp], names=[*rest, "fp"])

    return docs.select(*rest, text_col).mapInArrow(run, out)


def _forest(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(point, smallest linked point) for points that are linked within the radius, by way of others too."""
    label, bits = np.arange(len(points)), points.view(np.uint64)
    if len(points) == 2:
        return [(int(points[1]), int(points[0]))] if int(bits[0] ^ bits[1]).bit_count() <= radius else []
    while True:
        new = label.copy()
        for at in range(0, len(bits), 512):
            near = np.bitwise_count(bits[at : at + 512, None] ^ bits[None, :]) <= radius
            new[at : at + 512] = np.where(near, label[None, :], len(bits)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return [(int(points[i]), int(points[r])) for i, r in enumerate(label) if r != i]
        label = new


def _bucket_edges(buckets: DataFrame, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edges = [e for x in b.column(0) for e in _forest(np.sort(x.values.to_numpy(zero_copy_only=False)), radius)]
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])

    return buckets.select("fps").mapInArrow(run, "a bigint, b bigint")


def near_links(distinct: DataFrame, radius: int = RADIUS, cap: int = CAP) -> DataFrame:
    """Links (a, b) among the distinct fingerprints (column fp) that join all pairs within the radius, directly or through others."""
    masks = covering_masks(list(range(64)), radius)
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "key"))
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(keyed.join(sizes, ["t", "key"]), "met")
    light = met.where(F.col("n") <= cap).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))
    finer = [covering_masks([p for p in range(64) if not m >> p & 1], radius) for m in masks]
    submasks = F.array(*[F.array(*[F.lit(_signed(m | s)) for s in fine]) for m, fine in zip(masks, finer, strict=True)])
    split = met.where(F.col("n") > cap).select("t", "fp", F.posexplode(F.get(submasks, F.col("t"))).alias("s", "mask"))
    heavy = split.groupBy("t", "s", F.col("fp").bitwiseAND(F.col("mask")).alias("key")).agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return _bucket_edges(light.select("fps").union(heavy.select("fps")), radius)


@extras_apart("id_col", "text_col")
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, cap: int = CAP, broadcast_rows: int = NARROW_ROWS) -> DataFrame:
    """Each row of docs without its text, with `fp`, `root` (the component's smallest fingerprint) and `component_id`.

    Documents whose fingerprints differ in at most `radius` bits are linked; component_id is the smallest id reachable
    by links, the row's own included. Null and empty texts have fingerprint 0 and link like any other. Null ids are
    passed over for component_id, which is null only if the component has no other. Rows with equal ids are separate
    rows with the same component if their texts link. Other columns pass through; ones named fp, root or component_id
    give way. An empty table gives an empty result.
    """
    rest = [c for c in docs.columns if c not in ("fp", "root", "component_id") or c in (id_col, text_col)]
    marked = materialize(fingerprints(docs.select(*rest), text_col), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    roots = connected_components(near_links(distinct.select("fp"), radius, cap))
    member = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    member = materialize(member, "member")
    class_of = materialize(member.groupBy("root").agg(F.min("least").alias("component_id")), "classes")
    member = materialize(join_unique(member, class_of, "root", broadcast_rows).select("fp", "root", "component_id"), "member")
    # Many documents may share a fingerprint, and many fingerprints a root.
    return join_unique(marked, member, "fp", broadcast_rows)
