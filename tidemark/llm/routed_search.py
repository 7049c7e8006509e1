"""Approximate nearest neighbours by learned partitions.

Index: a bounded sample gives a neighbour graph; the graph is split into balanced parts that
cut few neighbour links (balanced clusters first, then moves of nodes to the part where most
of their neighbours are, while there is room); a small network learns the part of a vector
from the shares of its neighbours' parts. Every row of the table is then indexed by the
network's most probable part. Search: a query goes to its most probable parts and ranks all
their rows by the exact inner product in double precision.

The sample (SAMPLE rows with the smallest id digests) is the only thing the driver sees.
Parts are searched in bounded blocks, so a part of any size, or one vector repeated over a
third of the table, is spread over many tasks.

Defined results: vectors that are null or zero, or hold a null or non-finite component, or
whose length is not the most common one of the sample, take no part; of rows with one id the
one with the smallest vector counts; a query never finds its own id; ties go to the smaller
id; fewer candidates than k give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import blocks_for, checkpointed, unit_hash
from tidemark.llm.threshold import matrix, usable

SAMPLE, PARTS, PROBES, NEIGHBOURS = 6000, 16, 12, 16
BLOCK_ROWS, QUERY_ROWS = 4096, 2048
ROOM, HIDDEN, EPOCHS, SEED = 1.1, 96, 40, 7


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k rows with the largest inner product to each row, itself excluded."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        near = x[a:a + 512] @ x.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
        out[a:a + 512] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def _with_room(wish: np.ndarray, room: int) -> np.ndarray:
    """Each row to its most wanted part that has room; rows with most to lose choose first."""
    n, parts = wish.shape
    order = np.sort(wish, axis=1)
    left, out = np.full(parts, room), np.empty(n, np.int64)
    ranked = np.argsort(-wish, axis=1, kind="stable")
    for i in np.argsort(order[:, -2] - order[:, -1], kind="stable"):
        part = next(p for p in ranked[i] if left[p] > 0)
        out[i] = part
        left[part] -= 1
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Balanced partition of the neighbour graph."""
    rng = np.random.default_rng(SEED)
    room = int(np.ceil(len(x) / parts * ROOM))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    centre = unit[rng.choice(len(x), parts, replace=False)]
    for _ in range(rounds):
        part = _with_room(unit @ centre.T, room)
        centre = np.stack([unit[part == p].mean(0) if (part == p).any() else centre[p] for p in range(parts)])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    for _ in range(rounds):
        share = np.zeros((len(x), parts))
        for column in graph.T:
            np.add.at(share, (np.arange(len(x)), part[column]), 1.0)
            np.add.at(share, (column, part), 1.0)
        # A small preference for staying settles ties.
        share[np.arange(len(x)), part] += 0.5
        moved = _with_room(share, room)
        if (moved == part).all():
            break
        part = moved
    return part


@dataclasses.dataclass
class Router:
    """The classifier: one hidden layer over scaled components."""

    dims: int
    scale: float
    layers: list[np.ndarray]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(x * self.scale @ self.layers[0] + self.layers[1], 0.0)
        z = hidden @ self.layers[2] + self.layers[3]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return hidden, z / z.sum(axis=1, keepdims=True)

    def best(self, x: np.ndarray, count: int) -> np.ndarray:
        """Most probable parts of each row, best first."""
        return np.argsort(-self.forward(x)[1], axis=1, kind="stable")[:, :count]


def train_router(x: np.ndarray, shares: np.ndarray) -> Router:
    """Cross entropy against the shares of parts among a vector's neighbours, by Adam."""
    rng = np.random.default_rng(SEED)
    dims, parts = x.shape[1], shares.shape[1]
    layers = [rng.normal(0, np.sqrt(2 / dims), (dims, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    router = Router(dims, 1.0 / max(float(x.std()), 1e-12), layers)
    first, second, t = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for epoch in range(EPOCHS):
        for batch in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            hidden, p = router.forward(x[batch])
            slope = (p - shares[batch]) / len(batch)
            back = slope @ layers[2].T * (hidden > 0)
            grads = [(x[batch] * router.scale).T @ back, back.sum(0), hidden.T @ slope, slope.sum(0)]
            t += 1
            for w, g, a, b in zip(layers, grads, first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= 0.004 * (1 - epoch / EPOCHS) * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return router


def learn(vectors: DataFrame, sample: int = SAMPLE, parts: int = PARTS) -> Router | None:
    """Router from a sample of at most ``sample`` rows of (id, v); None without any."""
    rows = vectors.orderBy(unit_hash("id"), "id").limit(sample).collect()
    if not rows:
        return None
    sizes = [len(r["v"]) for r in rows]
    dims = max(set(sizes), key=lambda d: (sizes.count(d), d))
    x = np.array([r["v"] for r in rows if len(r["v"]) == dims], float)
    parts = max(1, min(parts, len(x) // 32))
    if parts == 1:
        return Router(dims, 1.0, [np.zeros((dims, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)])
    graph = neighbour_graph(x, min(NEIGHBOURS, len(x) - 1))
    part = balanced_parts(x, graph, parts)
    shares = np.zeros((len(x), parts))
    for column in [*graph.T, np.arange(len(x))]:
        shares[np.arange(len(x)), part[column]] += 1.0
    return train_router(x, shares / shares.sum(axis=1, keepdims=True))


def _routed(frame: DataFrame, router: Router, count: int) -> DataFrame:
    """(id, v) with the array ``parts`` of the ``count`` most probable parts."""
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def parts(v: pa.Array) -> pa.Array:
        best = router.best(matrix(v, router.dims, float), count)
        return pa.array(best.tolist(), pa.list_(pa.int32()))

    return frame.withColumn("parts", parts("v"))


def _unit(k: int, dims: int):
    def run(queries: pa.Table, members: pa.Table) -> pa.Table:
        found = ([], [], [])
        if queries.num_rows and members.num_rows:
            rows, ids = matrix(members.column("v"), dims, float), members.column("id").to_numpy()
            asked, own = matrix(queries.column("v"), dims, float), queries.column("id").to_numpy()
            for a in range(0, len(asked), 256):
                near = asked[a:a + 256] @ rows.T
                near[own[a:a + 256, None] == ids[None]] = -np.inf
                for q, scores in enumerate(near, a):
                    # Products are compared again in one fixed order of summation, so equal vectors tie exactly.
                    edge = np.partition(scores, -k)[-k] if len(scores) > k else -np.inf
                    close = np.nonzero((scores >= edge - 1e-9 * max(1.0, abs(edge))) & (scores > -np.inf))[0] if np.isfinite(edge) else np.nonzero(scores > -np.inf)[0]
                    exact = (rows[close] * asked[q]).sum(axis=1)
                    top = np.lexsort((ids[close], -exact))[:k]
                    found[0].append(np.full(len(top), own[q], np.int64))
                    found[1].append(ids[close][top])
                    found[2].append(exact[top])
        ints = [np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in found[:2]]
        return pa.table({"query_id": ints[0], "vec_id": ints[1], "score": np.concatenate([*found[2], np.zeros(0)])})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int, sample: int = SAMPLE, parts: int = PARTS, probes: int = PROBES,
           block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of the k nearest found.

    Both frames hold ``id`` and ``v``, an array of doubles without nulls.
    """
    vectors = checkpointed(vectors.where("id is not null").groupBy("id").agg(F.min("v").alias("v")))
    router = learn(vectors, sample, parts)
    if router is None:
        return vectors.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    fits = F.size("v") == router.dims
    members = checkpointed(_routed(vectors.where(fits), router, 1).select("id", "v", F.col("parts")[0].alias("part")))
    sizes = members.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per part
    blocks = F.create_map(*[x for r in sizes for x in (F.lit(r["part"]), F.lit(blocks_for(r["n"], block_rows)))])
    asked = checkpointed(_routed(queries.where("id is not null").groupBy("id").agg(F.min("v").alias("v")).where(fits), router, probes).withColumn(
        "part", F.explode("parts")).select("id", "v", "part"))
    chunks = blocks_for(asked.select("id").distinct().count(), query_rows)
    members = members.withColumn("block", F.pmod(F.xxhash64("id"), blocks[F.col("part")]).cast("int")).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")).withColumn("of", blocks[F.col("part")]).where(
        "of is not null").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    keys, columns = ("part", "block", "chunk"), ("part", "block", "chunk", "id", "v")
    found = asked.select(*columns).groupBy(*keys).cogroup(members.select(*columns).groupBy(*keys)).applyInArrow(
        _unit(k, router.dims), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def measured(vectors: DataFrame) -> DataFrame:
    """``id`` and ``v`` (doubles) of the usable, non-zero vectors of (vec_id, embedding)."""
    good = vectors.where(usable(F.col("embedding"))).where(F.exists("embedding", lambda x: x != 0))
    return good.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
