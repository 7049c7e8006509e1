"""Resampling without copies of rows: bootstrap sums as vectors, permutations as bijections of ranks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions.hashing import uniform

# Cumulative Poisson(1) probabilities for 0..8.
_POISSON = np.array([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
                     0.9994058151824183, 0.999916758850712, 0.9999897508033253, 0.999998874797402])
# The smallest 32-bit draw that reaches each of them.
_POISSON_DRAWS = np.ceil(_POISSON * 4294967296.0).astype(np.uint32)
# Start, turns and sines of MD5 (RFC 1321).
_MD5_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)
_MD5_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_MD5_SINES = np.floor(np.abs(np.sin(np.arange(1, 65, dtype=np.float64))) * 4294967296.0).astype(np.uint32)
# Digests computed at a time: their arrays stay in a core's cache.
DIGESTS = 16_384
# A multiplier and the Mersenne prime of a Lehmer generator, the permutations' round function.
LEHMER, MERSENNE, ROUNDS = 1583458089, 2147483647, 4
VECTOR_BLOCK, HELD_BYTES, BLOCK_ROWS, STRETCH = 250, 64_000_000, 4096, 128
# Rows of a slice of the drawn order; a task holds and sorts one slice.
SLICE_ROWS = 1 << 20


def _short_digests(heads: np.ndarray, tails: np.ndarray, size: int) -> np.ndarray:
    """MD5 of every head joined to every tail, as four numbers: all messages have ``size`` bytes and fit one block.

    Both are rows of 64 bytes with zeros where the other stands; the rounds run over all messages at a time.
    """
    end = np.zeros(64, np.uint8)
    end[size] = 0x80
    end[56:64] = np.frombuffer((8 * size).to_bytes(8, "little"), np.uint8)
    left, right = heads.view("<u4"), (tails | end).view("<u4")
    text = [right[:, None, i] if not left[:, i].any() else left[None, :, i] | right[:, None, i] for i in range(16)]
    shape = (len(tails), len(heads))
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _MD5_START)
    f, g = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        turn, at = i // 16, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, text[at] + _MD5_SINES[i], out=f)
        by = np.uint32(_MD5_TURNS[turn][i % 4])
        np.left_shift(f, by, out=g)
        np.right_shift(f, np.uint32(32) - by, out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=f)
        a, d, c, b, f = d, c, b, f, a
    return np.stack([x + y for x, y in zip((a, b, c, d), _MD5_START)], axis=-1)


def _digest_draws(names: Sequence[str | None], seed: int, count: int) -> np.ndarray:
    """The 32-bit numbers of the MD5 digests of (seed, 0 .. count - 1, name), four per digest, for every name."""
    out = np.empty((len(names), count, 4), ">u4")
    heads: dict[int, list[tuple[int, bytes]]] = {}
    for b in range(count):
        heads.setdefault(len(head := f"{seed}|{b}|".encode()), []).append((b, head))
    longest = max(heads, default=0)
    sizes: dict[int, list[int]] = {}
    texts = [None if name is None else name.encode() for name in names]
    for i, text in enumerate(texts):
        if text is not None and longest + len(text) <= 55:
            sizes.setdefault(len(text), []).append(i)
        else:
            digests = b"".join(hashlib.md5("|".join([str(seed), str(b), *([] if text is None else [names[i]])]).encode()).digest() for b in range(count))
            out[i] = np.frombuffer(digests, ">u4").reshape(count, 4)
    for size, members in sizes.items():
        body = np.frombuffer(b"".join(texts[i] for i in members), np.uint8).reshape(len(members), size)
        for at, group in heads.items():
            head = np.zeros((len(group), 64), np.uint8)
            head[:, :at] = np.frombuffer(b"".join(h for _, h in group), np.uint8).reshape(-1, at)
            tail = np.zeros((len(members), 64), np.uint8)
            tail[:, at:at + size] = body
            step, first = max(1, DIGESTS // len(group)), group[0][0]
            for i in range(0, len(members), step):
                # A digest is its numbers from the low byte up; a draw reads those bytes from the high one down.
                out[members[i:i + step], first:first + len(group)] = _short_digests(head, tail[i:i + step], at + size).byteswap()
    return out


def cluster_weights(names: Sequence[str | None], replicates: int, seed: int) -> np.ndarray:
    """Poisson(1) counts of each cluster in every replicate.

    A digest of (seed, replicate // 4, cluster) gives four of them, so the draws depend on nothing else.
    """
    draws = _digest_draws(names, seed, -(-replicates // 4)).astype(np.uint32).reshape(len(names), -1)[:, :replicates]
    out = np.zeros(draws.shape, np.int8)
    for least in _POISSON_DRAWS:
        out += draws >= least
    return out


def _local_groups(batch: pa.RecordBatch, names: Sequence[str]) -> tuple[np.ndarray, list[tuple]]:
    """Group number of every row by the named columns, and each group's values."""
    code = np.zeros(batch.num_rows, np.int64)
    for name in names:
        encoded = batch.column(name).dictionary_encode(null_encoding="encode")
        code = code * (len(encoded.dictionary) + 1) + encoded.indices.to_numpy(zero_copy_only=False)
    _, first, group = np.unique(code, return_index=True, return_inverse=True)
    picked = [batch.column(name).take(pa.array(first)).to_pylist() for name in names]
    return group, list(zip(*picked)) if names else [()] * len(first)


def replicate_sums(clusters: DataFrame, cluster: str, keys: Sequence[str], values: Sequence[str],
                   replicates: int, seed: int) -> DataFrame:
    """Per key, each value's weighted sum in every replicate, as an array of ``replicates`` numbers.

    Rows meet their cluster's weights where the cluster is, one weight vector per cluster; a
    task multiplies stretches of rows by them and adds the products into one vector per key.
    Vectors are written in blocks when they fill ``HELD_BYTES`` and summed by key and block, so
    neither rows nor draws are copied per replicate and a key of any size is spread over tasks.
    """
    rows = clusters.select(*keys, F.col(cluster).cast("string").alias("_cluster"), *[F.col(v).cast("double").alias(v) for v in values])
    vectors = T.StructType([*[rows.schema[k] for k in keys], T.StructField("_block", T.IntegerType()),
                            *[T.StructField(v, T.ArrayType(T.DoubleType())) for v in values]])
    blocks = -(-replicates // VECTOR_BLOCK)
    keys = list(keys)

    def written(held: dict, schema: pa.Schema) -> pa.RecordBatch:
        names = list(held)
        columns = [pa.array([n[i] for n in names for _ in range(blocks)], schema.field(k).type) for i, k in enumerate(keys)]
        columns.append(pa.array(list(range(blocks)) * len(names), pa.int32()))
        for i in range(len(values)):
            columns.append(pa.array([held[n][i, at:at + VECTOR_BLOCK] for n in names for at in range(0, replicates, VECTOR_BLOCK)], pa.list_(pa.float64())))
        return pa.RecordBatch.from_arrays(columns, names=[*keys, "_block", *values])

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        drawn: dict[str | None, np.ndarray] = {}
        schema = None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = batch.schema
            who, names = _local_groups(batch, ["_cluster"])
            missing = [n for (n,) in names if n not in drawn]
            fresh = cluster_weights(missing, replicates, seed) if missing else np.zeros((0, replicates), np.int8)
            # Rows are sorted by cluster: only the batch's own clusters are held.
            drawn = {n: drawn[n] for (n,) in names if n in drawn} | dict(zip(missing, fresh))
            weights = np.stack([drawn[n] for (n,) in names])
            group, found = _local_groups(batch, keys)
            order = np.argsort(group, kind="stable")
            data = np.stack([np.nan_to_num(batch.column(v).to_numpy(zero_copy_only=False)[order]) for v in values])
            group, who = group[order], who[order]
            for at in range(0, len(order), STRETCH):
                g, w = group[at:at + STRETCH], weights[who[at:at + STRETCH]].astype(np.float64)
                starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]])).tolist()
                for s, e in zip(starts, starts[1:]):
                    total = held.setdefault(found[g[s]], np.zeros((len(values), replicates)))
                    total += data[:, at + s:at + e] @ w[s:e]
                if len(held) * replicates * len(values) * 8 > HELD_BYTES:
                    yield written(held, schema)
                    held = {}
        if held:
            yield written(held, schema)

    # Many draws per row: partitions are not joined for being small in bytes.
    tasks = int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partial = rows.repartition(tasks, "_cluster").sortWithinPartitions("_cluster").mapInArrow(run, vectors)
    # Without keys all rows are one group; the block alone tells partial vectors apart.
    sums = partial.groupBy(*keys, "_block").applyInArrow(_vector_sum(keys, values), vectors)
    ordered = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_block", *values))).alias("_v"))
    return ordered.select(*keys, *[F.flatten(F.col("_v").getField(v)).alias(v) for v in values])


def _vector_sum(keys: Sequence[str], values: Sequence[str]):
    def run(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1)
        out = [first.column(k) for k in [*keys, "_block"]]
        for v in values:
            flat = table.column(v).combine_chunks()
            out.append(pa.array([flat.flatten().to_numpy().reshape(table.num_rows, -1).sum(axis=0)], pa.list_(pa.float64())))
        return pa.table(dict(zip([*keys, "_block", *values], out)))

    return run


def bootstrap(
    clusters: DataFrame, cluster: str, values: Sequence[str], metric: Callable[..., Column], replicates: int = 2000,
    seed: int = 42, level: float = 0.95, keys: Sequence[str] = (),
) -> DataFrame:
    """Point estimate, percentile interval and all sorted draws ``stats`` of a metric over cluster summaries.

    ``metric`` gets the (weighted) sums of ``values`` as columns, for example
    ``lambda s, n: s / n``; any user metric that is a function of sums fits.
    """
    keys = list(keys)
    point = clusters.groupBy(*keys).agg(metric(*[F.sum(v) for v in values]).alias("estimate"), F.count(F.lit(1)).alias("clusters"))
    sums = replicate_sums(clusters, cluster, keys, values, replicates, seed)
    stats = sums.select(*keys, F.sort_array(F.transform(
        F.arrays_zip(*values), lambda x: metric(*[x[v] for v in values]))).alias("stats"))
    lo = int((1 - level) / 2 * replicates)
    hi = max(0, min(int((1 - (1 - level) / 2) * replicates) - 1, replicates - 1))
    joined = point.join(stats, keys) if keys else point.withColumn("stats", stats.scalar())
    err = F.aggregate("stats", F.lit(0.0), lambda a, x: a + (x - F.col("estimate")) * (x - F.col("estimate")), lambda a: F.sqrt(a / F.size("stats")))
    return joined.select(*keys, "clusters", "estimate", F.get("stats", F.lit(lo)).alias("ci_lower"),
                         F.get("stats", F.lit(hi)).alias("ci_upper"), err.alias("std_error"), "stats")


def centred_p(clusters: DataFrame, cluster: str, value: str, keys: Sequence[str],
              replicates: int = 2000, seed: int = 42) -> DataFrame:
    """Mean of cluster values with a two-sided null-centred bootstrap p-value per key."""
    keys = list(keys)
    observed = clusters.groupBy(*keys).agg(F.avg(value).alias("effect"), F.count(F.lit(1)).alias("n_clusters"))
    centred = clusters.join(observed, keys).select(*keys, cluster, (F.col(value) - F.col("effect")).alias("_x"), F.lit(1.0).alias("_one"))
    sums = replicate_sums(centred, cluster, keys, ["_x", "_one"], replicates, seed).join(observed, keys)
    extreme = F.size(F.filter(F.arrays_zip("_x", "_one"), lambda s: F.abs(F.try_divide(s["_x"], s["_one"])) >= F.abs("effect")))
    return sums.select(*keys, "effect", "n_clusters", ((extreme + F.lit(1.0)) / F.lit(replicates + 1.0)).alias("p_value"))


def round_keys(seed: int, rep: int) -> list[int]:
    """Keys of the rounds of one replicate's permutation."""
    return [int.from_bytes(hashlib.md5(f"{seed}|{rep}|{t}".encode()).digest()[:4], "big") // 2 for t in range(ROUNDS)]


def half_bits(size: int) -> int:
    """Half the bits of the smallest domain of an even number of bits that holds ``size``."""
    return max(1, -(-max(1, size - 1).bit_length() // 2))


def bijection(size: int, keys: Sequence[int]) -> np.ndarray:
    """A keyed permutation of 0..size-1: Feistel rounds, walked until the result is inside."""
    h = half_bits(size)
    mask = (1 << h) - 1

    def step(x):
        left, right = x >> h, x & mask
        for key in keys:
            left, right = right, left ^ (((right + key) * LEHMER % MERSENNE >> 8) & mask)
        return left << h | right

    out = step(np.arange(size, dtype=np.int64))
    while (outside := out >= size).any():
        out[outside] = step(out[outside])
    return out


@lru_cache(maxsize=512)
def drawn_bijection(size: int, seed: int, rep: int) -> np.ndarray:
    """The permutation of one replicate; a group's blocks have two sizes, so a worker draws it twice for all of them."""
    return bijection(size, round_keys(seed, rep))


def _dealt(slices: pa.Table, groupings: int, columns: Sequence[str], schema: pa.Schema, block_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows of one slice, in order, as arrays: one row for every block that they are dealt to."""
    carried = slices.filter(pc.is_valid(slices.column("_carry"))).select(["_carry"]).combine_chunks()
    rows = slices.filter(pc.is_null(slices.column("_carry"))).combine_chunks()
    starts: dict[tuple, tuple] = {}
    for c in carried.column("_carry").to_pylist():
        starts[c["which"], c["key"]] = (c["before"], c["n"])
    for which in range(groupings):
        known = np.flatnonzero(rows.column(f"_g{which}").is_valid().to_numpy(zero_copy_only=False))
        if not len(known):
            continue
        keys = rows.column(f"_g{which}").combine_chunks().take(pa.array(known)).dictionary_encode()
        names, group = keys.dictionary.to_pylist(), keys.indices.to_numpy()
        before, n = (np.array([starts[which, name][i] for name in names], np.int64) for i in (0, 1))
        by = np.argsort(group, kind="stable")
        rank = np.empty(len(group), np.int64)
        rank[by] = np.arange(len(group)) - np.searchsorted(group[by], group[by])
        rank += before[group]
        blocks = -(-n // block_rows)
        block, at = rank % blocks[group], rank // blocks[group]
        by = np.lexsort((at, block, group))
        first = np.flatnonzero(np.concatenate([[True], (np.diff(group[by]) != 0) | (np.diff(block[by]) != 0)]))
        places = pa.array(np.append(first, len(by)), pa.int32())
        held = [pa.ListArray.from_arrays(places, rows.column(c).combine_chunks().take(pa.array(known[by]))) for c in columns]
        of = by[first]
        plain = [np.full(len(of), which), keys.dictionary.take(pa.array(group[of])), n[group[of]], block[of], at[of]]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) if isinstance(x, np.ndarray) else x.cast(f.type) for x, f in zip([*plain, *held], schema)], schema=schema)


def ranked_blocks(df: DataFrame, groupings: Sequence[Sequence[str]], row: Sequence[str], columns: Sequence[str], seed: int,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of each group in an order drawn by digest, dealt to blocks whose sizes differ by one at most.

    Per grouping (its place in ``groupings``), group (``_g``) and block: ``_n`` rows in the group,
    ``_block``, ``_size`` and an array per column. Rows without a group are in no block.

    All groupings share one order, so rows are cut once into slices of it; a slice is told how
    many rows of each group lie before it, and what it deals to a block leaves as arrays.
    """
    c, spark = F.col, df.sparkSession
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // SLICE_ROWS))
    def key(group: Sequence[str]) -> Column:
        name = c(group[0]) if len(group) == 1 else F.to_json(F.struct(*group)) if group else F.lit("")
        return F.when(reduce(and_, [c(g).isNotNull() for g in group], F.lit(True)), name.cast("string"))

    keys = {f"_g{i}": key(group) for i, group in enumerate(groupings)}
    # A draw has 32 bits; as a whole number it is half zeros on its way.
    drawn = df.withColumn("_u", F.floor(uniform(seed, *[c(r) for r in row]) * F.lit(4294967296.0))).select(
        *[k.alias(name) for name, k in keys.items()], *row, *[x for x in columns if x not in row], "_u",
        F.floor(c("_u") * slices / F.lit(4294967296.0)).cast("int").alias("_slice"))
    counted = drawn.select("_slice", F.explode(F.array(*[F.struct(F.lit(i).alias("which"), c(g).alias("key")) for i, g in enumerate(keys)])).alias("x")).where(
        "x.key is not null").groupBy("x.which", "x.key", "_slice").agg(F.count(F.lit(1)).alias("here"))
    group = Window.partitionBy("which", "key")
    carry = counted.select("_slice", F.struct(
        "which", "key", F.coalesce(F.sum("here").over(group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("here").over(group).alias("n")).alias("_carry"))
    both = drawn.unionByName(carry, allowMissingColumns=True)
    schema = T.StructType([T.StructField("_grouping", T.IntegerType()), T.StructField("_g", T.StringType()), *[T.StructField(x, T.LongType()) for x in ("_n", "_block", "_at")],
                           *[T.StructField(x, T.ArrayType(df.schema[x].dataType)) for x in columns]])
    arrow, columns, count = to_arrow_schema(schema), list(columns), len(keys)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            number = batch.column("_slice").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for at, to in zip(cuts, cuts[1:]):
                if to == at:
                    continue
                if held and held[-1].column("_slice")[0].as_py() != number[at]:
                    yield from _dealt(pa.Table.from_batches(held), count, columns, arrow, block_rows)
                    held = []
                held.append(batch.slice(at, to - at))
        if held:
            yield from _dealt(pa.Table.from_batches(held), count, columns, arrow, block_rows)

    parts = both.repartition(slices, "_slice").sortWithinPartitions("_slice", "_u", *row).select("_slice", "_carry", *keys, *columns).mapInArrow(deal, schema)
    whole = parts.groupBy("_grouping", "_g", "_n", "_block").agg(F.array_sort(F.collect_list(F.struct("_at", *columns))).alias("_rows"))
    arrays = whole.select("_grouping", "_g", "_n", "_block", *[F.flatten(c("_rows").getField(x)).alias(x) for x in columns])
    return arrays.withColumn("_size", F.size(columns[0]).cast("long"))


def coded(values: np.ndarray) -> bytes:
    """Numbers as bytes: a bit each if all are 0 or 1, else eight bytes each."""
    if ((values == 0) | (values == 1)).all():
        return b"b" + np.packbits(values != 0).tobytes()
    return b"d" + values.astype("<f8").tobytes()


def decoded(held: bytes, size: int) -> np.ndarray:
    """The ``size`` numbers of :func:`coded`."""
    if held[:1] == b"b":
        return np.unpackbits(np.frombuffer(held, np.uint8, offset=1), count=size).astype(float)
    return np.frombuffer(held, "<f8", offset=1)


def permuted_losses(df: DataFrame, group: Sequence[str], row: Sequence[str], stay: Sequence[str], move: Sequence[str],
                    loss: Callable[..., np.ndarray], replicates: int, seed: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """:func:`permuted_losses_by` for one grouping."""
    return permuted_losses_by(df, [group], row, stay, move, loss, replicates, seed, block_rows).drop("grouping")


def permuted_losses_by(df: DataFrame, groupings: Sequence[Sequence[str]], row: Sequence[str], stay: Sequence[str], move: Sequence[str],
                       loss: Callable[..., np.ndarray], replicates: int, seed: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``grouping``, ``rep``, ``kind``, ``loss`` and ``n``: summed losses when the ``move`` columns are permuted inside groups.

    Replicate ``rep`` turns the blocks of equal size round by a drawn number of places and
    permutes inside a block by a keyed bijection of ranks. Rows never move: each block meets the
    ``move`` columns of one other block per replicate, and ``loss(*stay, *move)`` runs in numpy;
    it gives a loss per row, or a table of them with one line per kind.
    """
    c, keys = F.col, ["_grouping", "_g"]
    stay, move = list(stay), list(move)
    blocks = ranked_blocks(df, groupings, row, list(dict.fromkeys([*stay, *move])), seed, block_rows)
    total = F.ceil(c("_n") / block_rows).cast("long")
    big = F.pmod(c("_n"), total)
    is_big = c("_block") < big
    first, count = F.when(is_big, F.lit(0)).otherwise(big), F.when(is_big, big).otherwise(total - big)
    codes = T.StructType([T.StructField("_grouping", T.IntegerType()), T.StructField("_g", T.StringType()),
                          *[T.StructField(x, T.LongType()) for x in ("_block", "_first", "_count")], *[T.StructField(f"_m{i}", T.BinaryType()) for i in range(len(move))]])
    arrow = to_arrow_schema(codes)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved = [pa.array([coded(x.values.to_numpy(zero_copy_only=False).astype(float)) for x in batch.column(m)], pa.binary()) for m in move]
            yield pa.RecordBatch.from_arrays([*[batch.column(x).cast(arrow.field(x).type) for x in arrow.names[:5]], *moved], schema=arrow)

    names = [f"_m{i}" for i in range(len(move))]
    turns = blocks.select(*keys, "_block", first.alias("_first"), count.alias("_count"), *dict.fromkeys(move)).mapInArrow(code, codes).withColumn(
        "rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    turn = F.floor(uniform(seed, c("rep"), F.lit("turn")) * c("_count")).cast("long")
    sent = turns.withColumn("_to", c("_first") + F.pmod(c("_block") - c("_first") - turn, c("_count"))).select(
        c("_grouping").alias("_of"), c("_g").alias("_in"), "_to", "rep", *names)

    def run(own: pa.Table, others: pa.Table) -> pa.Table:
        here = [own.column(x)[0].values.to_numpy(zero_copy_only=False).astype(float) for x in stay]
        size, which = own.column("_size")[0].as_py(), own.column("_grouping")[0].as_py()
        reps = others.column("rep").to_pylist()
        out = []
        for i, rep in enumerate(reps):
            at = drawn_bijection(size, seed, rep)
            lost = np.atleast_2d(loss(*here, *[decoded(others.column(m)[i].as_py(), size)[at] for m in names])).sum(axis=1)
            out += [(which, rep, kind, float(x), size) for kind, x in enumerate(lost)]
        kinds = zip(("grouping", "rep", "kind", "loss", "n"), zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64()))
        return pa.table({name: pa.array(values, of) for name, values, of in kinds})

    own = blocks.select(*keys, "_block", "_size", *stay)
    sums = own.groupBy(*keys, "_block").cogroup(sent.groupBy("_of", "_in", "_to")).applyInArrow(run, "grouping int, rep int, kind int, loss double, n long")
    return sums.groupBy("grouping", "rep", "kind").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n"))


def uniform_sql(text: str) -> str:
    """SQL text of a uniform draw from the first 32 bits of an MD5 digest."""
    return f"(cast(('0x' || substr(md5({text}), 1, 8)) as bigint) / 4294967296e0)"


def weights_sql(replicates: int, cluster: str, table: str = "cl", seed: int = 42) -> str:
    """SQL text: rows of ``table`` with replicate ``b`` and the cluster's weight ``w``."""
    draw = f"(cast(('0x' || substr(md5('{seed}|' || (b // 4) || '|' || k), 1 + 8 * (b % 4), 8)) as bigint) / 4294967296e0)"
    steps = " + ".join(f"(u >= {s!r}::double)::int" for s in _POISSON.tolist())
    return f"""(select c.*, b, w from {table} c join (select k, b, {steps} as w from (select k, b, {draw} as u from (select distinct cast({cluster} as varchar) as k from {table}), range({replicates}) r(b))) q
 on q.k = cast(c.{cluster} as varchar))"""


def permuted_sql(name: str, table: str, group: str, row: Sequence[str], stay: Sequence[str], move: Sequence[str],
                 replicates: int, seed: int, block_rows: int = BLOCK_ROWS) -> str:
    """SQL text of common tables that end in ``name``: rows with the permuted columns ``m_*`` per ``rep``.

    ``group`` is an expression; a constant permutes over all rows.
    """
    ident = " || '|' || ".join(row)
    rounds = "x0"
    for t in range(ROUNDS):
        rounds = (f"(select * replace ((x & ((1 << h) - 1)) << h | xor(x >> h, ((((x & ((1 << h) - 1)) + k{t}) * {LEHMER} % {MERSENNE}) >> 8) & ((1 << h) - 1)) as x) "
                  f"from {rounds})")

    def walked(source: str, where: str = "") -> str:
        return rounds.replace("x0", f"(select * from {source}{where})", 1)

    return f"""{name}_r as (select {group} as g, {', '.join([*stay, *move])}, row_number() over (partition by {group} order by {uniform_sql(f"'{seed}|' || {ident}")}, {', '.join(row)}) - 1 as k,
  count(*) over (partition by {group}) as n from {table}),
{name}_b as (select *, k % nb as blk, k // nb as o, n % nb as big, n // nb + (k % nb < n % nb)::int as size from (select *, (n + {block_rows - 1}) // {block_rows} as nb from {name}_r)),
{name}_s as (select distinct size, greatest(1, (length(bin(greatest(1, size - 1))) + 1) // 2)::bigint as h from {name}_b),
{name}_k as (select rep, {', '.join(f"cast(('0x' || substr(md5('{seed}|' || rep || '|{t}'), 1, 8)) as bigint) // 2 as k{t}" for t in range(ROUNDS))} from range(1, {replicates + 1}) r(rep)),
{name}_w as (select * from {walked(f"(select size, h, rep, k0, k1, k2, k3, o, o as x from {name}_s, range(0, {block_rows}) q(o), {name}_k where o < size)")}
  union all select * from {walked(f"{name}_w", " where x >= size")}),
{name} as (
  select a.*, w.rep, {', '.join(f'm.{c} as m_{c}' for c in move)} from (
    select b.*, rep, case when blk < big then 0 else big end as f, case when blk < big then big else nb - big end as c,
      cast(floor({uniform_sql(f"'{seed}|' || rep || '|turn'")} * case when blk < big then big else nb - big end) as bigint) as turn from {name}_b b, range(1, {replicates + 1}) r(rep)) a
  join {name}_w w on w.size = a.size and w.rep = a.rep and w.o = a.o and w.x < a.size
  join {name}_b m on m.g = a.g and m.blk = a.f + (a.blk - a.f + a.turn) % a.c and m.o = w.x)"""
