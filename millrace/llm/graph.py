"""Connected components of a large graph, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import HOT_ROWS, discard, join_unique, materialize

#: Steps double the reach of a label, so this many serve any graph that can be stored.
MAX_ROUNDS = 64
#: Labels of so many nodes at most are broadcast; more are shuffled, but for those of hot nodes.
NARROW_ROWS = 100_000


def _large_star(edges: DataFrame, rows: int, hot_rows: int) -> DataFrame:
    """Each node's larger neighbours are linked to the least of it and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
    above = join_unique(both.where("b > a"), least, "a", rows, hot_rows)
    return above.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, rows: int, hot_rows: int) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of those; a > b in all edges."""
    least = materialize(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    linked = join_unique(edges, least, "a", rows, hot_rows).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, rows: int = NARROW_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b), root the component's smallest node.

    Nodes are of one orderable type; edges may repeat, loops and edges with a null are left out, and no edges give no
    rows. Each round is written to the shared folder, so no round's lineage grows. A node of very many edges, as the
    centre of a star, has its label broadcast: its edges never meet in one task. Raises RuntimeError if MAX_ROUNDS do
    not settle it, rather than return parts.
    """
    edges = materialize(edges.where("a <> b").distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        stars = materialize(_large_star(edges, rows, hot_rows), "stars")
        discard(edges)
        edges = materialize(_small_star(stars, rows, hot_rows), "edges")
        discard(stars)
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
