"""Nearest neighbours with a permutation index: pivot orders, inverted files, footrule, exact rerank."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .base import stored


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the vectors that take part: finite, not zero, of the commonest length."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                          F.col(vector_col).cast("array<double>").alias("vector"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull()).filter(~bad & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1)
    first = sizes.first()
    return rows.filter(F.size("vector") == (first["n"] if first else 0))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def orders(x: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """The `depth` nearest pivots of each vector, nearest first."""
    gap = (pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T)
    return np.argsort(gap, axis=1, kind="stable")[:, :depth]


def _search(pivots: np.ndarray, depth: int, share: float, least: int, k: int):
    n_pivots = len(pivots)

    def run(key, left, right):
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            left = left.sort_by("vec_id")
            ids, x = left["vec_id"].to_numpy(), _matrix(left["vector"])
            order = orders(x, pivots, depth)
            # inverted files: for each pivot its vectors and the place it has in their orders
            flat = order.ravel()
            by_pivot = np.argsort(flat, kind="stable")
            bounds = np.searchsorted(flat[by_pivot], np.arange(n_pivots + 1))
            owner, place = by_pivot // depth, (by_pivot % depth).astype(np.int32)
            budget = min(len(ids), max(least, int(np.ceil(share * len(ids)))))
            asked, q = right["vec_id"].to_numpy(), _matrix(right["vector"])
            for qid, vector, its in zip(asked, q, orders(q, pivots, depth)):
                # footrule of two truncated orders, counted from "nothing in common":
                # a shared pivot at i and j saves (depth - i) + (depth - j) - |i - j|
                saved = np.zeros(len(ids), np.int32)
                for i, p in enumerate(its):
                    low, high = bounds[p], bounds[p + 1]
                    saved[owner[low:high]] += 2 * (depth - np.maximum(place[low:high], i))
                # equal footrule: smaller id first
                near = np.argsort(-saved, kind="stable")[:budget + 1]
                near = near[ids[near] != qid]
                near = np.sort(near)
                gap = np.sqrt(((x[near] - vector) ** 2).sum(1))
                best = np.argsort(gap, kind="stable")[:k]
                out[0].append(np.full(len(best), qid))
                out[1].append(ids[near][best])
                out[2].append(gap[best])
        cols = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({"query_id": pa.array(cols[0].astype(np.int64)), "vec_id": pa.array(cols[1].astype(np.int64)),
                         "score": pa.array(cols[2].astype(np.float64))})
    return run


def permutation_search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id",
                       vector_col: str = "embedding", k: int = 10, n_pivots: int = 256, depth: int = 64,
                       share: float = 0.2, least: int = 256, block_rows: int = 8192,
                       query_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, nearest first.

    `n_pivots` vectors (those with the smallest id hash: the documented, bounded sample the index is
    fitted on) order the space. Every vector is represented by its `depth` nearest pivots in order
    and posted in their inverted files, block by block; each query meets each block once, ranks it by
    footrule distance and reranks the best `share` of it by exact Euclidean distance. A block pair's
    task holds `block_rows` vectors and `query_rows` queries; it returns k rows per query.

    Defined cases: null, zero and non-finite vectors and vectors of another than the commonest length
    take no part, as queries or candidates; null ids neither; a row is no candidate for its own id;
    ties go to the smaller id; with fewer than k candidates all are returned; empty inputs give an
    empty result; other columns are not read.
    """
    rows = stored(usable(vectors, id_col, vector_col), "vectors")
    asked = usable(queries, id_col, vector_col)
    n = rows.count()
    pivots = np.array([r["vector"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).collect()])
    pivots = np.unique(pivots, axis=0) if len(pivots) else np.zeros((1, 1))
    blocks, groups = max(1, -(-n // block_rows)), max(1, -(-asked.count() // query_rows))
    deal = lambda m: F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = rows.select("vec_id", "vector", deal(blocks).alias("block"), every(groups).alias("group"))
    right = asked.select("vec_id", "vector", deal(groups).alias("group"), every(blocks).alias("block"))
    found = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(
        _search(pivots, min(depth, len(pivots)), share, least, k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.distinct().withColumn("rank", rank).filter(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
