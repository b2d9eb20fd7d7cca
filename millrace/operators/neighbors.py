"""Nearest vectors by cosine similarity: exact in blocks, or over the cells of an inverted-file index.

Rows lie in blocks of bounded size within their cell; queries are gathered in blocks for each cell that they probe, and
meet the cell's blocks one pair of blocks a row. A pair is one matrix product, of which each query keeps its best few. So
no pairs of vectors are made, and a cell of a third of all rows is spread over its blocks. A cell's blocks are in GROUPS
groups at most, and queries are sent once to each: what is shuffled grows as the input, and none of it goes through the
driver. The exact search is the same with a single cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.storage import materialize

#: Rows of a block, about; rows of a product that are looked through at once.
BLOCK, SLICE = 2048, 256
#: In so many groups a cell's blocks are joined at most.
GROUPS = 64
#: Centroids are fitted on so many rows at most, those of the least hashes, in so many rounds.
SAMPLE, ROUNDS = 65_536, 10
MOST_CELLS = 16_384
#: How many cells to probe is measured on the sample: so many of its rows are queries, whose best K must be found so often.
TRIALS, K, RECALL = 1000, 10, 0.93
#: Similarities are compared after rounding, so that equal vectors tie whatever the order of their sums.
DIGITS = 6


@dataclass
class Index:
    """blocks: cell, block, n and `of`, its rows' ids and vectors in the order of id. cells: cell and how many blocks it has.
    centroids: one row each, of norm 1; none for a single cell. probes: in how many cells a query has to look."""

    blocks: DataFrame
    cells: DataFrame
    centroids: np.ndarray | None
    dimensions: int
    probes: int


def _matrix(vectors: pa.Array, dimensions: int) -> np.ndarray:
    """Rows of norm 1."""
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _plain(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector of the rows that have a direction; all must have the same number of dimensions."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("vector")).where(F.col("id").isNotNull() & sound)


def _centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means; an empty cell keeps its centroid."""
    at = sample[np.random.default_rng(42).choice(len(sample), cells, replace=False)]
    for _ in range(ROUNDS):
        own = np.concatenate([(sample[k : k + 4096] @ at.T).argmax(axis=1) for k in range(0, len(sample), 4096)])
        sums = np.zeros_like(at)
        np.add.at(sums, own, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        at = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), at)
    return at


def _probes(sample: np.ndarray, centroids: np.ndarray) -> int:
    """In how many cells the nearest rows of the sample's first ones lie, RECALL of them. Rows of a sample lie farther
    apart than those of the whole, and their neighbours in more cells: so many find no less there."""
    tried = sample[:TRIALS]
    cell = np.concatenate([(sample[k : k + 4096] @ centroids.T).argmax(axis=1) for k in range(0, len(sample), 4096)])
    needed = []
    for at in range(0, len(tried), SLICE):
        part = tried[at : at + SLICE]
        near = np.round(part @ sample.T, DIGITS)
        near[np.arange(len(part)), at + np.arange(len(part))] = -np.inf
        q, r = np.nonzero(_best(near, K))
        place = np.argsort(np.argsort(-(part @ centroids.T), axis=1), axis=1)
        needed.append(place[q, cell[r]] + 1)
    needed = np.sort(np.concatenate(needed))
    return int(needed[min(len(needed) - 1, int(RECALL * len(needed)))]) if len(needed) else 1


def build_index(vectors: DataFrame, cells: int = 0, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> Index:
    """An index of every row of vectors (ids that can be ordered; arrays of numbers of one length) over so many cells; -1:
    as many as the root of the number of rows, MOST_CELLS at most; 0 or 1: one cell, for an exact search.

    The centroids are fitted on SAMPLE rows at most, those whose ids have the least hashes; then each row goes to the cell
    of its nearest centroid. Rows with a null id, and vectors that are null, hold a null, NaN or infinity, or have no
    direction (empty, all zero), are in no index. Rows of the same id stand for themselves. Raises ValueError if vectors
    differ in length. Other columns are left out."""
    plain = _plain(vectors, id_col, vector_col)
    low, high, n = plain.agg(F.min(F.size("vector")), F.max(F.size("vector")), F.count("*")).first()
    if low != high:
        raise ValueError(f"vectors of {low} to {high} dimensions")
    dimensions = low or 0
    cells = min(MOST_CELLS, int(n**0.5)) if cells < 0 else min(cells, n)
    centroids, probes = None, 1
    if cells > 1:
        least = plain.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow().column("vector").combine_chunks()
        sample = _matrix(least, dimensions)
        centroids = _centroids(sample, min(cells, len(sample)))
        probes = _probes(sample, centroids)
    placed = materialize(_assigned(plain, centroids, dimensions, 1), "placed")
    blocks_of = F.ceil(F.count("*") / block).cast("int")
    # At most MOST_CELLS rows.
    counted = materialize(placed.groupBy("cell").agg(blocks_of.alias("n_blocks")), "cells")
    dealt = placed.join(F.broadcast(counted), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int"))
    of = F.sort_array(F.collect_list(F.struct("id", "vector")))
    return Index(materialize(dealt.groupBy("cell", "block").agg(of.alias("of")), "blocks"), counted, centroids, dimensions, probes)


def _assigned(rows: DataFrame, centroids: np.ndarray | None, dimensions: int, probes: int) -> DataFrame:
    """rows (id, vector) with `cell`, in as many rows as each has cells to probe: those of its nearest centroids."""
    if centroids is None:
        return rows.withColumn("cell", F.lit(0))
    probes = min(probes, len(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            near = _matrix(b.column(1), dimensions) @ centroids.T
            cell = np.argpartition(-near, probes - 1, axis=1)[:, :probes] if probes < len(centroids) else np.broadcast_to(np.arange(probes), near.shape)
            index = pa.array(np.repeat(np.arange(b.num_rows), probes))
            yield pa.RecordBatch.from_arrays([*[c.take(index) for c in b.columns], pa.array(cell.ravel().astype(np.int32))], names=["id", "vector", "cell"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())]))


def _best(near: np.ndarray, k: int) -> np.ndarray:
    """Which of each row's columns are its k largest, the first ones of equal columns; -inf is none."""
    if near.shape[1] > k:
        least = np.partition(near, -k, axis=1)[:, -k, None]
        tied = near == least
        near_enough = (near > least) | (tied & (tied.cumsum(axis=1) <= k - (near > least).sum(axis=1, keepdims=True)))
        return near_enough & (near > -np.inf)
    return near > -np.inf


def search(queries: DataFrame, index: Index, k: int = 10, probes: int = 0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows of the index most similar to each of queries: query_id, rank from 1, id and similarity, a cosine rounded
    to DIGITS. Of equal ones the least ids come first; rows of the query's own id are left out. probes: in how many of the
    index's cells each query looks; 0 is as many as the index's own measure says. Queries without a direction or an id have no rows, nor has
    anything in an empty index; a query of another length raises. Queries of the same id count as one, if their vectors
    are equal."""
    own = _assigned(_plain(queries, id_col, vector_col).distinct(), index.centroids, index.dimensions, probes or index.probes)
    asked = own.join(F.broadcast(index.cells), "cell")
    per_cell = F.broadcast(materialize(asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_n")), "asked"))
    gathered = asked.join(per_cell, "cell").groupBy("cell", "n_blocks", F.pmod(F.xxhash64("id"), F.col("_n")).alias("_q")).agg(F.collect_list(F.struct("id", "vector")).alias("queries"))
    # Each block of queries goes to each group of the cell's blocks. Either side is as large as its table or larger, but
    # shrinks when written, so that without a hint it may be broadcast.
    sent = gathered.withColumn("_group", F.explode(F.sequence(F.lit(0), F.least(F.col("n_blocks"), F.lit(GROUPS)) - 1)))
    grouped = index.blocks.withColumn("_group", F.pmod("block", F.lit(GROUPS)))
    met = sent.join(grouped.hint("merge"), ["cell", "_group"]).select("queries", "of")
    kind, dimensions = index.blocks.schema["of"].dataType.elementType["id"].dataType, index.dimensions
    out = T.StructType().add("query_id", kind).add("id", kind).add("similarity", T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                (ids, m), (found, rows) = ((x.field(0), _matrix(x.field(1), dimensions)) for x in (b.column(c)[i].values for c in (0, 1)))
                names = np.asarray(found.to_pylist())
                for at in range(0, len(m), SLICE):
                    near = np.round(m[at : at + SLICE] @ rows.T, DIGITS)
                    near[np.asarray(ids[at : at + SLICE].to_pylist())[:, None] == names[None, :]] = -np.inf
                    q, r = np.nonzero(_best(near, k))
                    yield pa.RecordBatch.from_arrays([ids[at : at + SLICE].take(pa.array(q)), found.take(pa.array(r)), pa.array(near[q, r])], names=out.names)

    each = met.mapInArrow(run, out)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")
