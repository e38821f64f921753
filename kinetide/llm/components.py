"""Connected components by alternating star steps on edge tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from kinetide.llm.common import discard, staged

ROWS_PER_FILE = 50_000


def _written(edges: DataFrame, rows: int | None = None) -> tuple[DataFrame, int, int]:
    """The edges as a table, their number and a sum of their hashes, found while they are written."""
    seen = Observation()
    edges = edges if rows is None else edges.coalesce(max(8, rows // ROWS_PER_FILE))
    edges = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("s"))
    edges = staged(edges, "edges")
    return edges, seen.get["n"], seen.get["s"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge, component the smallest node; edges: columns a, b, any order and repeats.

    A step hangs each node's neighbours under the smallest of them, which halves paths; stars stay as they are. Minima are
    aggregated before they are shuffled, and the joins are plain, so that a hot node is split by the adaptive planner.
    Null ends and loops are left out; an empty table gives an empty one.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, rows, _ = _written(edges)
    seen = None
    while rows:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large, _, _ = _written(both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")), rows)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        old = edges, large
        edges, rows, sums = _written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), rows)
        discard(*old)
        if seen == (rows, sums):
            break
        seen = rows, sums
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
