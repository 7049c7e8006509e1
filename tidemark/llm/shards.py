"""Shards of nearly equal bytes from indivisible groups, by Karmarkar-Karp differencing.

Rows that belong together form a group with a size. A partial partition is a tuple of shard
sums; differencing takes the two partial partitions with the largest spread and joins them
oppositely ordered, largest sum to smallest, until one is left. Groups are dealt by their
digest into bounded buckets, each bucket is differenced in one task, and the buckets' own
partitions, now 24 sums each with tiny spreads, are differenced the same way, level by level
for as long as there are more than one task should hold.

A group heavier than a fair shard cannot be kept whole in balanced shards: it alone is cut,
by row, into the fewest parts that fit. There are fewer such groups than shards.

Defined results: a null text has 0 bytes and counts 8; null texts form one group and empty
texts another, apart from each other; repeated rows stay in their group; no rows, no shards.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import blocks_for, checkpointed

BUCKET_GROUPS, TOP_PARTITIONS, SLOT_ROWS = 20_000, 2_000, 50_000


def difference(sums: np.ndarray) -> np.ndarray:
    """Karmarkar-Karp over partial partitions.

    ``sums`` has a row per partial partition and a column per part. Returns, per row and
    column, the part of the final partition that it goes to.
    """
    n, k = sums.shape
    if n == 0:
        return np.zeros((0, k), np.int64)
    value = [np.sort(row)[::-1] for row in sums]
    order = [np.argsort(-row, kind="stable") for row in sums]
    children: list[tuple[int, int, np.ndarray] | None] = [None] * n
    heap = [(-int(v[0] - v[-1]), i) for i, v in enumerate(value)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        joined = value[a] + value[b][::-1]
        rank = np.argsort(-joined, kind="stable")
        children.append((a, b, rank))
        value.append(joined[rank])
        value[a] = value[b] = None
        heapq.heappush(heap, (-int(joined[rank[0]] - joined[rank[-1]]), len(value) - 1))
    # Places run down the tree: place j of a joined partition holds place rank[j] of a and the opposite of b.
    final = np.empty((n, k), np.int64)
    stack = [(heap[0][1], np.arange(k))]
    while stack:
        node, part = stack.pop()
        if children[node] is None:
            final[node, order[node]] = part
            continue
        a, b, rank = children[node]
        back = np.empty(k, np.int64)
        back[rank] = part
        stack += [(a, back), (b, back[::-1])]
    return final


def _local(k: int):
    """Per bucket: the part of every group, and the bucket's own partial partition as k sums."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("group_bytes", "descending"), ("group_key", "ascending"), ("piece", "ascending")])
        size = table.column("group_bytes").to_numpy()
        start = np.zeros((len(size), k), np.int64)
        start[:, 0] = size
        part = difference(start)[:, 0]
        return pa.table({"bucket": table.column("bucket"), "group_key": table.column("group_key"), "piece": table.column("piece"),
                         "group_bytes": table.column("group_bytes"), "part": pa.array(part, pa.int32())})

    return run


def _merge(k: int):
    """Per parent bucket: where each part of each child bucket goes."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")
        sums = np.array(table.column("sums").to_pylist(), np.int64).reshape(-1, k)
        to = difference(sums)
        return pa.table({"parent": table.column("parent"), "bucket": table.column("bucket"),
                         "sums": pa.array(sums.tolist(), pa.list_(pa.int64())), "moved": pa.array(to.tolist(), pa.list_(pa.int32()))})

    return run


def assign_groups(groups: DataFrame, shards: int, total_groups: int, bucket_groups: int = BUCKET_GROUPS,
                  top: int = TOP_PARTITIONS) -> DataFrame:
    """``group_key``, ``piece``, ``shard`` from (group_key, piece, group_bytes)."""
    buckets = blocks_for(total_groups, bucket_groups)
    dealt = groups.withColumn("bucket", F.pmod(F.xxhash64("group_key", "piece"), F.lit(buckets)).cast("int"))
    local = checkpointed(dealt.groupBy("bucket").applyInArrow(
        _local(shards), "bucket int, group_key string, piece int, group_bytes long, part int"))
    sums = local.groupBy("bucket").agg(
        F.array(*[F.coalesce(F.sum(F.when(F.col("part") == i, F.col("group_bytes"))), F.lit(0)) for i in range(shards)]).alias("sums"))
    lookup = local.select("bucket", "part").distinct().withColumn("home", F.col("bucket")).select("home", "part", "bucket", F.col("part").alias("at"))
    while True:
        parents = blocks_for(buckets, top)
        merged = sums.withColumn("parent", F.pmod(F.col("bucket"), F.lit(parents))).groupBy("parent").applyInArrow(
            _merge(shards), "parent int, bucket int, sums array<long>, moved array<int>")
        merged = checkpointed(merged)
        lookup = lookup.join(merged.select("bucket", "parent", "moved"), "bucket").select(
            "home", "part", F.col("parent").alias("bucket"), F.element_at("moved", F.col("at") + 1).alias("at"))
        if parents == 1:
            break
        placed = merged.select(F.col("parent").alias("bucket"), F.posexplode("sums").alias("i", "bytes"), "moved").withColumn(
            "at", F.element_at("moved", F.col("i") + 1))
        sums = placed.groupBy("bucket").agg(
            F.array(*[F.coalesce(F.sum(F.when(F.col("at") == i, F.col("bytes"))), F.lit(0)) for i in range(shards)]).alias("sums"))
        buckets = parents
    lookup = lookup.select(F.col("home").alias("bucket"), "part", F.col("at").alias("shard"))
    return local.join(lookup, ["bucket", "part"]).select("group_key", "piece", "shard")


def sharded(docs: DataFrame, shards: int, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every row.

    Size is the UTF-8 bytes of the text plus 8, groups are equal texts, slots are gapless per
    shard in an order that depends on the rows only.
    """
    rows = checkpointed(docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32("text").alias("text_crc32"),
        F.coalesce(F.md5("text"), F.lit("null")).alias("group_key")))
    groups = rows.groupBy("group_key").agg(F.sum("size").alias("group_bytes"))
    count, total = groups.agg(F.count(F.lit(1)), F.sum("group_bytes")).first()
    fair = max(1, (total or 0) // shards)
    # Fewer than `shards` groups can be heavier than a fair shard.
    heavy = {r["group_key"]: blocks_for(r["group_bytes"], fair) for r in groups.where(F.col("group_bytes") > fair).collect()}
    piece = F.lit(0)
    for key, parts in heavy.items():
        piece = F.when(F.col("group_key") == key, F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")).otherwise(piece)
    rows = rows.withColumn("piece", piece)
    placed = assign_groups(rows.groupBy("group_key", "piece").agg(F.sum("size").alias("group_bytes")), shards, count)
    out = checkpointed(rows.join(placed, ["group_key", "piece"]))
    # Gapless slots: number rows inside bounded blocks of a shard, then add what precedes the block.
    n = rows.count()
    blocks = blocks_for(n, shards * slot_rows)
    out = out.withColumn("block", F.pmod(F.xxhash64("doc_id", "group_key"), F.lit(blocks)).cast("int"))
    sizes = out.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("block_rows"))
    before = sizes.select("shard", "block", F.coalesce(
        F.sum("block_rows").over(W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = W.partitionBy("shard", "block").orderBy("doc_id", "group_key")
    numbered = out.withColumn("within", F.row_number().over(inside) - 1).join(before, ["shard", "block"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("within")).cast("long").alias("slot"))
