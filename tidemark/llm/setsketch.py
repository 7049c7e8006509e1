"""Near-duplicate classes from SetSketch registers, banded, estimated jointly and verified.

A document is the set of its word shingles. Every element starts a Poisson process over the
registers; a register keeps the smallest arrival over all elements, on an exponential scale
truncated to one byte. Sketches of parts merge by the element-wise maximum, and equal
registers are about as likely as the sets are similar.

1. Rows with equal sets form a class, represented by the smallest id.
2. Bands of registers give buckets. A bucket links its members to its smallest id only, so
   the number of candidate edges is linear in the bucket.
3. The joint likelihood of two sketches and the exact set sizes estimates the similarity of
   each edge; edges more than six standard errors under the threshold are not verified.
4. Edges are verified on the full sets: first the best one of every representative, then
   those that still join different components.
5. Pairs that met in a bucket through its smallest id, and are still in different
   components, are verified on the full sets in blocks: a cell holds a component's hubs and
   all that met them. A block returns a spanning set of links, not its pairs, and members
   of the largest component of a cell meet only the others.
   So a link between different texts is lost only if the two share no bucket at all, which
   at the threshold has probability (1 - 0.8^5)^40, about one in ten million.

Defined results: a null text, and one without words, has the empty set, size 0, and is
linked with nothing; a text of fewer words than a shingle has one element; repeated rows are
one class; only ``doc_id`` and ``text`` are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import ASCII_LOWER, blocks_for, checkpointed, mix64, words
from tidemark.operators.graph import connected_components

ROWS, BANDS = 5, 40
REGISTERS = ROWS * BANDS
BASE, TOP, LONGEST = 1.1, 254, 32.0
# Elements sketched at a time, and members of a verified block.
SLICE, BLOCK = 400_000, 300


def shingles(text: str | None, size: int, known: dict[str, int] | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    found = words(text.translate(ASCII_LOWER)) if text else []
    if not found:
        return np.zeros(0, np.uint64)
    if known is None:
        known = {}
    elif len(known) > 300_000:
        known.clear()
    get = known.get
    codes = [get(w) for w in found]
    if None in codes:
        for i, w in enumerate(found):
            if codes[i] is None:
                codes[i] = known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    h = np.array(codes, np.uint64)
    size = min(size, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = mix64(out ^ h[i:i + n]) * np.uint64(2 * i + 3)
    return np.unique(out)


def sketch(sets: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """Registers of every set, one byte each; zero rows for empty sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    state = mix64(np.concatenate([*sets, np.zeros(0, np.uint64)]))
    least = np.full((len(sets), registers), LONGEST)
    flat = least.reshape(-1)
    at = np.zeros(len(state))
    step = np.uint64(0xD1B54A32D192ED03)
    live = np.ones(len(sets), bool)
    while len(owner):
        with np.errstate(over="ignore"):
            state = state + step
        draw = mix64(state)
        # The upper 53 bits space the arrival, the lower bits choose its register.
        gap = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / registers
        at = at + gap
        slot = owner * registers + (mix64(draw) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(flat, slot, at)
        rows = np.nonzero(live)[0]
        bound = np.full(len(sets), -1.0)
        bound[rows] = least[rows].max(axis=1)
        keep = at < bound[owner]
        owner, state, at = owner[keep], state[keep], at[keep]
        live = np.zeros(len(sets), bool)
        live[owner] = True
    level = np.floor(1.0 - np.log(least / LONGEST) / np.log(BASE))
    out = np.clip(level, 0, TOP + 1).astype(np.uint8)
    out[sizes == 0] = 0
    return out


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood Jaccard similarity of sketch rows with known set sizes."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    equal = a.shape[1] - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    top = np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0.0, 1.0) * (BASE - 1.0) / BASE) / np.log(BASE)

    def score(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return more * np.log(up + tiny) + less * np.log(down + tiny) + equal * np.log(np.maximum(1.0 - up - down, tiny))

    low, high = np.zeros(len(a)), top.copy()
    for _ in range(40):  # the likelihood has one peak: ternary search
        left, right = low + (high - low) / 3, high - (high - low) / 3
        better = score(left) < score(right)
        low, high = np.where(better, left, low), np.where(better, high, right)
    return (low + high) / 2


def _described(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id``, ``n``, digest of the set and sketch of every row."""

    def run(batches):
        known: dict[str, int] = {}
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            sets, start = [], 0
            for i in range(batch.num_rows + 1):
                if i == batch.num_rows or sum(map(len, sets)) > SLICE:
                    if sets:
                        yield pa.RecordBatch.from_arrays([
                            ids.slice(start, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                            pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary()),
                            pa.array([r.tobytes() for r in sketch(sets)], pa.binary())], names=["doc_id", "n", "digest", "registers"])
                    sets, start = [], i
                if i < batch.num_rows:
                    sets.append(shingles(texts[i].as_py(), size, known))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n long, digest binary, registers binary")


@F.arrow_udf(T.ArrayType(T.LongType()))
def _bands(registers: pa.Array) -> pa.Array:
    data = np.frombuffer(b"".join(registers.to_pylist()), np.uint8).reshape(-1, BANDS, ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), data.shape[:2])
    for i in range(ROWS):
        out = mix64(out ^ (data[:, :, i].astype(np.uint64) << np.uint64(8)))
    flat = pa.array(out.view(np.int64).reshape(-1), pa.int64())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), flat)


@F.arrow_udf(T.DoubleType())
def _estimate(a: pa.Array, b: pa.Array, n_a: pa.Array, n_b: pa.Array) -> pa.Array:
    left, right = (np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(-1, REGISTERS) for x in (a, b))
    return pa.array(similarity(left, right, n_a.to_numpy().astype(float), n_b.to_numpy().astype(float)), pa.float64())


def _linked(percent: int, size: int, a: Column, b: Column) -> Column:
    """Whether the full shingle sets of two texts are similar enough."""
    @F.arrow_udf(T.BooleanType())
    def check(left: pa.Array, right: pa.Array) -> pa.Array:
        known: dict[str, int] = {}
        cached = lru_cache(maxsize=64)(lambda t: shingles(t, size, known))
        out = []
        for x, y in zip(left, right):
            s, t = cached(x.as_py()), shingles(y.as_py(), size, known)
            common = len(np.intersect1d(s, t, assume_unique=True))
            out.append(100 * common >= percent * (len(s) + len(t) - common))
        return pa.array(out, pa.bool_())

    return check(a, b)


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs (a, b) whose full sets are linked."""
    left, right = (texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    return both.where(_linked(percent, size, F.col("text_a"), F.col("text_b"))).select("a", "b")


def _components(links: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """``id`` and ``component`` of every linked representative; parts: components already found, which new links join."""
    links = links.select("a", "b")
    if parts is not None:
        links = checkpointed(links)
        if links.isEmpty():
            return parts
        links = links.unionByName(parts.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")))
    found = connected_components(links, "a", "b")
    return checkpointed(found.select(F.col("node").alias("id"), F.col("component")).dropDuplicates(["id"]))


def _unit(percent: int, size: int):
    """A spanning set of the links between the two sides of one block pair."""

    def run(table: pa.Table) -> pa.Table:
        known: dict[str, int] = {}
        rows = table.select(["id", "component", "side"]).to_pylist()
        sets = [shingles(t.as_py(), size, known) for t in table.column("text")]
        root = {r["component"]: r["component"] for r in rows}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        ids, where = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
        lengths = np.array([len(s) for s in sets], np.int64)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        held = np.array([r["side"] != 0 for r in rows])  # side 0 asks, 1 answers, 2 does both
        links = []
        mark = np.zeros(len(ids), bool)
        for i, r in enumerate(rows):
            if r["side"] == 1 or not lengths[i]:
                continue
            mine = where[bounds[i]:bounds[i + 1]]
            mark[mine] = True
            common = np.add.reduceat(np.concatenate([mark[where], [False]]).astype(np.int64), bounds[:-1]) if len(where) else np.zeros(len(rows))
            mark[mine] = False
            good = held & (lengths > 0) & (100 * common >= percent * (lengths + lengths[i] - common))
            for j in np.nonzero(good)[0].tolist():
                x, y = find(r["component"]), find(rows[j]["component"])
                if x != y:
                    root[x] = y
                    links.append((r["id"], rows[j]["id"]))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def _cells(edges: DataFrame, parts: DataFrame, texts: DataFrame, percent: int, size: int, block: int) -> DataFrame:
    """Links between members of a cell that are in different components.

    A cell is a component with its hubs and all that met one of them in a bucket.
    """
    named = parts.select(F.col("id").alias("part_id"), "component")
    hubs = edges.select("b").distinct().join(named, F.col("b") == F.col("part_id"), "left").select(
        "b", F.coalesce("component", F.col("b")).alias("cell"))
    members = edges.select("a", "b").join(hubs, "b").select("cell", F.col("a").alias("id")).unionByName(
        hubs.select("cell", F.col("b").alias("id"))).distinct()
    members = checkpointed(members.join(named, F.col("id") == F.col("part_id"), "left").select(
        "cell", "id", F.coalesce("component", F.col("id")).alias("component")))
    sizes = members.groupBy("cell", "component").agg(F.count(F.lit(1)).alias("n"))
    cells = sizes.groupBy("cell").agg(
        F.max_by("component", F.struct("n", -F.col("component"))).alias("main"), F.max("n").alias("main_n"), F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("components"))
    # A cell of one hub and one member was settled by its edge.
    cells = cells.where("components > 1 and n > 2").select(
        "cell", "main", F.ceil(F.col("main_n") / block).cast("int").alias("main_blocks"),
        F.ceil((F.col("n") - F.col("main_n")) / block).cast("int").alias("other_blocks"))
    placed = members.join(cells, "cell").withColumn("is_main", F.col("component") == F.col("main"))
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("is_main"), F.col("main_blocks")).otherwise(F.col("other_blocks"))).cast("int")
    placed = placed.withColumn("mine", mine)
    others = F.sequence(F.lit(0), F.col("other_blocks") - 1)
    # Units (kind, i, j): 0 joins main block i with other block j, 1 joins other blocks i <= j.
    main_units = F.transform(others, lambda j: F.struct(F.lit(0).alias("kind"), F.col("mine").alias("i"), j.alias("j"), F.lit(1).alias("side")))
    with_main = F.transform(F.sequence(F.lit(0), F.col("main_blocks") - 1), lambda i: F.struct(
        F.lit(0).alias("kind"), i.alias("i"), F.col("mine").alias("j"), F.lit(0).alias("side")))
    among = F.transform(others, lambda j: F.struct(
        F.lit(1).alias("kind"), F.least("mine", j).alias("i"), F.greatest("mine", j).alias("j"),
        F.when(j == F.col("mine"), 2).when(j > F.col("mine"), 0).otherwise(1).alias("side")))
    units = placed.select("cell", "id", "component", F.explode(
        F.when(F.col("is_main"), main_units).otherwise(F.concat(with_main, among))).alias("u"))
    filled = units.join(texts, "id").select("cell", "u.kind", "u.i", "u.j", "u.side", "id", "component", "text")
    return filled.groupBy("cell", "kind", "i", "j").applyInArrow(_unit(percent, size), "a long, b long")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row.

    Rows are linked when 100 * |intersection| >= percent * |union| of their shingle sets; a
    component is named by its smallest id. A row without a doc_id is its own, kept, component.
    """
    described = checkpointed(_described(docs, shingle_words))
    classes = described.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"))
    classes = checkpointed(classes)
    reps = checkpointed(described.join(classes, (F.col("doc_id") == F.col("id")) & described["digest"].eqNullSafe(classes["digest"]), "left_semi")
                        .select(F.col("doc_id").alias("id"), "n", "registers").dropDuplicates(["id"]))
    banded = reps.select("id", F.explode(_bands("registers")).alias("key"))
    hubs = banded.groupBy("key").agg(F.min("id").alias("b"), F.max("id").alias("last")).where("last > b").select("key", "b")
    edges = checkpointed(banded.join(hubs, "key").where("id > b").groupBy(F.col("id").alias("a"), "b").agg(F.count(F.lit(1)).alias("met")))
    one, two = (reps.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}")) for x in "ab")
    floor = percent / 100.0 - 6.0 * float(np.sqrt(percent / 100.0 * (1 - percent / 100.0) / REGISTERS))
    able = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    likely = edges.join(one, "a").join(two, "b").where(able).select("a", "b", _estimate("r_a", "r_b", "n_a", "n_b").alias("similar"))
    likely = checkpointed(likely.where(F.col("similar") >= floor))
    involved = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    texts = checkpointed(docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(involved, "id", "left_semi").dropDuplicates(["id"]))
    best = likely.groupBy("a").agg(F.max_by("b", F.struct("similar", -F.col("b"))).alias("b"))
    parts = _components(_verified(best, texts, percent, shingle_words))
    one, two = (parts.select(F.col("id").alias(x), F.col("component").alias(f"c_{x}")) for x in "ab")
    rest = likely.join(best, ["a", "b"], "left_anti").join(one, "a", "left").join(two, "b", "left").where(
        F.coalesce("c_a", "a") != F.coalesce("c_b", "b"))
    parts = _components(_verified(rest, texts, percent, shingle_words), parts)
    parts = _components(_cells(edges, parts, texts, percent, shingle_words, block), parts)
    named = classes.join(parts, "id", "left").select(
        F.col("digest").alias("class"), F.coalesce("component", F.col("id")).alias("root"))
    out = described.join(named, (F.col("digest") == F.col("class")) & (F.col("n") > 0), "left")
    root = F.coalesce(F.when(F.col("n") > 0, F.col("root")), F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), root.alias("component_id"),
                      F.coalesce(F.col("doc_id") == root, F.lit(True)).alias("kept"))
