"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists.

Rows are dealt into bounded blocks. A block sorts its rows once by every dimension; a query
walks the lists of its non-zero dimensions from their favourable end, scores in full every
row it meets, and stops when the best that any unseen row could reach, the query times the
list values at the current depth, is below its k-th score. The blocks' winners are merged.
The stated query set meets every block; nothing is sampled or capped.

Scores are integers, so ties are exact and go to the smaller id.

Defined results: vectors that are null, or hold a null or non-finite component, take no
part; a missing component of a shorter vector counts as zero; of rows with one id the one
with the smallest vector counts; a query never finds its own id; fewer candidates than k
give fewer rows, and no candidates none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import blocks_for, checkpointed

BLOCK_ROWS, QUERY_ROWS, FIRST_DEPTH = 4096, 1024, 8


def usable(vector: Column) -> Column:
    """Whether a vector has components, none of them null or non-finite."""
    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))

    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False))


def matrix(lists: pa.ChunkedArray | pa.Array, dims: int, kind) -> np.ndarray:
    """Rows of numbers, padded with zeros to one width."""
    rows = lists.to_pylist()
    out = np.zeros((len(rows), dims), kind)
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
    return out


def walk(rows: np.ndarray, ids: np.ndarray, order: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Threshold algorithm for one query over one block; its k best (ids, scores)."""
    dims = np.nonzero(query)[0]
    up = query[dims] > 0
    n = len(rows)
    seen = ids == own
    best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    depth, step = 0, FIRST_DEPTH
    while depth < n:
        to = min(n, depth + step)
        # Favourable end: the largest values of dimensions the query likes, the smallest of the others.
        met = np.concatenate([order[n - to:n - depth, dims[up]].ravel(), order[depth:to, dims[~up]].ravel()]) if len(dims) else np.arange(depth, to)
        fresh = np.zeros(n, bool)
        fresh[met] = True
        fresh &= ~seen
        seen |= fresh
        new = np.nonzero(fresh)[0]
        best_ids, best = np.concatenate([best_ids, ids[new]]), np.concatenate([best, rows[new] @ query])
        keep = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[keep], best[keep]
        last = np.where(up, order[n - to, dims], order[to - 1, dims])
        bound = int((rows[last, dims] * query[dims]).sum())
        if len(best) == k and best[-1] > bound:
            break
        depth, step = to, step * 2
    return best_ids, best


def _unit(k: int, dims: int):
    def run(queries: pa.Table, members: pa.Table) -> pa.Table:
        found = ([], [], [])
        if queries.num_rows and members.num_rows:
            rows, ids = matrix(members.column("v"), dims, np.int64), members.column("id").to_numpy()
            order = np.argsort(rows, axis=0, kind="stable")
            asked = matrix(queries.column("v"), dims, np.int64)
            for own, query in zip(queries.column("id").to_pylist(), asked):
                near, score = walk(rows, ids, order, query, own, k)
                found[0].append(np.full(len(near), own, np.int64))
                found[1].append(near)
                found[2].append(score)
        flat = [np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in found]
        return pa.table({"query_id": flat[0], "vec_id": flat[1], "score": flat[2]})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of the k best of each query.

    Both frames hold ``id`` and ``v``, an array of integers without nulls.
    """
    vectors = checkpointed(vectors.where("id is not null").groupBy("id").agg(F.min("v").alias("v")))
    queries = checkpointed(queries.where("id is not null").groupBy("id").agg(F.min("v").alias("v")))
    n, dims = vectors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    asked, wide = queries.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    blocks, chunks = blocks_for(n, block_rows), blocks_for(asked, query_rows)
    members = vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    sides = queries.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = sides.select("block", "chunk", "id", "v").groupBy("block", "chunk").cogroup(
        members.select("block", "chunk", "id", "v").groupBy("block", "chunk")).applyInArrow(
        _unit(k, max(dims or 1, wide or 1)), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scaled(vectors: DataFrame, factor: int = 256) -> DataFrame:
    """``id`` and ``v`` = floor(factor * component) of the usable vectors of (vec_id, embedding)."""
    good = vectors.where(usable(F.col("embedding")))
    return good.select(F.col("vec_id").cast("long").alias("id"),
                       F.transform("embedding", lambda x: F.floor(x.cast("double") * factor).cast("long")).alias("v"))
