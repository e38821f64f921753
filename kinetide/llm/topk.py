"""Exact top-k search by inner product: branch and bound over blocks of dimensions in columnar layout."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from kinetide.llm.common import staged

STEP = 8  # dimensions looked at before candidates are compacted
QUERIES, CANDIDATES = 256, 8192  # most of a block


def _matrix(rows: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((dims, len(rows)), np.int64)
    for i, v in enumerate(rows):
        out[:len(v), i] = v
    return out


def best_of_block(ids: np.ndarray, columns: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, id, score) of each query's k best of the block, ties to the smaller id; columns and queries: dimensions by vectors.

    Dimensions come in blocks, those with the largest values first. After each block a candidate's score lies within
    |q rest| * |c rest| of its partial sum; those whose upper bound is below the k-th best lower bound are dropped and the
    others moved together.
    """
    order = np.argsort(-np.abs(columns).sum(axis=1), kind="stable")
    columns, queries = columns[order], queries[order]
    dims, starts = len(order), list(range(0, len(order), STEP))
    tail = lambda m: np.sqrt(np.vstack([np.cumsum(np.square(m.astype(np.float64))[::-1], axis=0)[::-1], np.zeros(m.shape[1])]))
    rest, rest_q, out = tail(columns), tail(queries), []
    for number, query in enumerate(query_ids):
        q, live = queries[:, number], np.flatnonzero(ids != query)
        sums, whole = np.zeros(len(live), np.int64), True
        for start in starts:
            block = columns[start:start + STEP]
            sums = sums + q[start:start + STEP] @ (block if whole and len(live) == len(ids) else block[:, live])
            end = min(start + STEP, dims)
            if end < dims and len(live) > k:
                slack = rest[end][live] * rest_q[end, number] * (1 + 1e-9)
                floor = np.partition(sums - slack, len(live) - k)[len(live) - k]
                keep = sums + slack >= floor
                if not keep.all():
                    live, sums, whole = live[keep], sums[keep], False
        if len(live) > k:
            least = np.partition(sums, len(live) - k)[len(live) - k]
            keep = sums >= least
            live, sums = live[keep], sums[keep]
        best = sorted(zip((-sums).tolist(), ids[live].tolist()))[:k]
        out += [(int(query), i, -s) for s, i in best]
    return out


def _search(k: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        wanted = group["query"].to_numpy()
        dims = max(1, int(group["v"].map(len).max()))
        candidates, queries = group[~wanted], group[wanted]
        if not len(candidates) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        found = best_of_block(candidates["vec_id"].to_numpy(), _matrix(candidates["v"], dims), queries["vec_id"].to_numpy(), _matrix(queries["v"], dims), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")
    return run


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v) with v = floor(scale * x). Left out: null ids, vectors that are null, empty or hold null or non-finite
    components. Of rows with one vec_id the least vector stays, so repeated rows count once."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where("vec_id is not null and size(embedding) > 0").where(good)
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("e")).select("vec_id", F.transform("e", lambda x: F.floor(F.lit(scale) * x)).alias("v"))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other vectors by inner product of whole components.

    Queries are the vectors whose id is divisible by `every`. Both sides are cut into blocks of bounded size and each pair
    of blocks is one group, so that neither side is ever in one place; a group returns at most k rows a query, and those are
    ranked natively. Shorter vectors count as filled up with zeros. Scores must stay below 2^63. Vectors that
    whole_vectors leaves out take no part; an empty table gives an empty one, other columns are not read.
    """
    rows = staged(whole_vectors(vectors), "vectors")
    n, nq = rows.count(), rows.where(F.col("vec_id") % every == 0).count()
    blocks, query_blocks = max(1, -(-n // CANDIDATES)), max(1, -(-nq // QUERIES))
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    at = lambda m, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(m)).cast("int")
    candidates = rows.select(F.lit(False).alias("query"), at(blocks, 1).alias("c"), numbers(query_blocks).alias("q"), "vec_id", "v")
    queries = rows.where(F.col("vec_id") % every == 0).select(F.lit(True).alias("query"), numbers(blocks).alias("c"), at(query_blocks, 2).alias("q"), "vec_id", "v")
    found = candidates.unionByName(queries).groupBy("c", "q").applyInPandas(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
