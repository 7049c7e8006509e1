"""Repeated lines: lines whose key stands in many documents stay in one of them only.

1. Every document gives the 128-bit digest of each long line's key and the line's place.
2. Digests are range-partitioned and sorted by digest, document (largest first) and place, so
   a line in a third of all documents is spread over as many partitions as it fills.
3. Each partition tells its first and last digest, with document counts and end points: two
   rows a partition, whatever the data. They settle the digests that span partitions.
4. Each partition is streamed: the document met first keeps its lines, the others are marked
   once enough documents are seen. At most ``min_documents - 1`` documents wait undecided.
5. Marks become one compressed bitmap per document (bit i: line i stays); no text is shuffled
   until a caller asks for the kept text (:func:`kept_lines`).

Defined results: null and empty texts are one empty line; rows without an id keep all lines
and count for nothing; repeated rows are one document and all keep or lose the same lines;
rows of one id with different texts count as one document, and each keeps its lines if the id
is the largest that holds the key; ties cannot occur between different ids; other columns are
not read; no rows, no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import checkpointed, slices

MIN_CODE_POINTS, MIN_DOCUMENTS = 40, 5
_BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
_OCCURRENCE = ["hi", "lo", "doc_id", "sig", "place"]


def line_keys(text: bytes, min_code_points: int) -> tuple[list[bytes], list[int]]:
    """Digests and places of the lines whose key is long enough. ``bytes.lower`` changes A-Z only."""
    digests, places = [], []
    for place, line in enumerate(text.lower().split(b"\n")):
        key = line.strip(_BLANKS)
        if len(key) >= min_code_points and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= min_code_points):
            digests.append(xxhash.xxh3_128_digest(key))
            places.append(place)
    return digests, places


def _described(docs: DataFrame, min_code_points: int) -> DataFrame:
    """Digest halves and places of each document's long lines; ``sig`` tells the texts of one id apart."""

    def run(batches):
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            for a, b in slices(lengths, 4_000_000):
                part = batch.slice(a, b - a)
                found, places, counts = [], [], []
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    d, p = line_keys(text or b"", min_code_points)
                    found += d
                    places += p
                    counts.append(len(p))
                ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                halves = np.frombuffer(b"".join(found), ">i8").astype(np.int64).reshape(-1, 2)
                lists = [pa.ListArray.from_arrays(ends, pa.array(v, t)) for v, t in
                         ((halves[:, 0], pa.int64()), (halves[:, 1], pa.int64()), (places, pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("sig"), *lists], names=["doc_id", "sig", "hi", "lo", "place"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("sig"), "text").mapInArrow(
        run, "doc_id long, sig long, hi array<long>, lo array<long>, place array<int>")


def _groups(hi: np.ndarray, lo: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal digests, and how many documents each holds (documents are sorted inside)."""
    fresh = np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])
    other = fresh | np.concatenate([[True], doc[1:] != doc[:-1]])
    starts = np.flatnonzero(fresh)
    return starts, np.add.reduceat(other.astype(np.int64), starts)


def _ends(batches):
    """First and last digest of a sorted partition: documents, largest and smallest of them."""
    first = now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        hi, lo, doc = (batch.column(c).to_numpy() for c in _OCCURRENCE[:3])
        starts, n = _groups(hi, lo, doc)
        for g in sorted({0, len(starts) - 1}):
            a, b = starts[g], starts[g + 1] if g + 1 < len(starts) else len(hi)
            seen = [int(hi[a]), int(lo[a]), int(n[g]), int(doc[a]), int(doc[b - 1])]
            if now is not None and now[:2] == seen[:2]:
                now = [*now[:2], now[2] + seen[2] - (now[4] == seen[3]), now[3], seen[4]]
            else:
                first = first or now
                now = seen
    rows = [r for r in (first, now) if r is not None]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5,
                                     names=["hi", "lo", "n", "top", "low"])


def _spanning(rows) -> dict[tuple[int, int], tuple[int, int]]:
    """Documents and largest document of each digest at a partition's end, over all partitions."""
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    for r in sorted(rows, key=lambda r: (r.hi, r.lo, -r.top, -r.low)):
        n, top, low = out.get((r.hi, r.lo), (0, r.top, None))
        out[(r.hi, r.lo)] = (n + r.n - (low == r.top), top, r.low)
    return {key: (n, top) for key, (n, top, _) in out.items()}


def _marks(spanning: dict[tuple[int, int], tuple[int, int]], min_documents: int):
    """Stream a sorted partition; give document and place of every line to drop."""

    def run(batches):
        known = dict(spanning)
        edge = np.unique(np.array([k[0] for k in known], np.int64))
        waiting = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in _OCCURRENCE]
            if waiting is not None:
                columns = [np.concatenate(both) for both in zip(waiting, columns)]
            hi, lo, doc, sig, place = columns
            starts, n = _groups(hi, lo, doc)
            top = doc[starts].copy()
            watched = np.flatnonzero(np.isin(hi[starts], edge))
            for g in {*watched.tolist(), 0}:
                told = known.get((int(hi[starts[g]]), int(lo[starts[g]])))
                if told:
                    n[g], top[g] = told
            # The last digest may go on in the next batch: decided already, or its few documents wait.
            last = starts[-1]
            waiting = None
            if n[-1] >= min_documents:
                known[(int(hi[last]), int(lo[last]))] = (int(n[-1]), int(top[-1]))
            else:
                waiting = [c[last:] for c in columns]
            size = np.diff(np.append(starts, len(hi)))
            gone = np.repeat(n >= min_documents, size) & (doc != np.repeat(top, size))
            yield pa.RecordBatch.from_arrays([pa.array(c[gone]) for c in (doc, sig, place)], names=["doc_id", "sig", "place"])

    return run


@F.arrow_udf(T.BinaryType())
def _bitmap(n_lines: pa.Array, gone: pa.Array) -> pa.Array:
    """Compressed bits of the lines that stay, first line first."""
    out = []
    for n, places in zip(n_lines.to_pylist(), gone.to_pylist()):
        keep = np.ones(n, bool)
        keep[places or []] = False
        out.append(zlib.compress(np.packbits(keep).tobytes()))
    return pa.array(out, pa.binary())


@F.arrow_udf(T.StringType())
def _kept(text: pa.Array, keep: pa.Array) -> pa.Array:
    """Lines whose bit is set, joined by line feeds."""
    out = []
    for t, bits in zip(text.to_pylist(), keep.to_pylist()):
        if bits is None:
            out.append(None)
            continue
        found = (t or "").split("\n")
        stays = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=len(found))
        out.append("\n".join(line for line, stay in zip(found, stays.tolist()) if stay))
    return pa.array(out, pa.string())


def line_count(text) -> F.Column:
    """Lines of a text; one for null and empty texts."""
    return F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))), F.lit(0)).cast("long") + 1


def occurrences(docs: DataFrame, min_code_points: int = MIN_CODE_POINTS) -> DataFrame:
    """Sorted line digests in range partitions, written to the checkpoint folder."""
    described = checkpointed(_described(docs, min_code_points))
    lines = described.select("doc_id", "sig", F.monotonically_increasing_id().alias("row"), F.explode(F.arrays_zip("hi", "lo", "place")).alias("at")).select(
        "at.hi", "at.lo", "doc_id", "sig", "at.place", "row")
    # The row splits repeated rows too, so no partition bound is forced together by equal keys.
    order = [F.col("hi"), F.col("lo"), F.col("doc_id").desc(), F.col("sig"), F.col("place"), F.col("row")]
    return checkpointed(lines.repartitionByRange(*order).sortWithinPartitions(*order).select(*_OCCURRENCE))


def keep_bitmaps(docs: DataFrame, min_code_points: int = MIN_CODE_POINTS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``doc_id``, ``sig``, ``n_dropped`` and ``keep`` of every document that loses lines; the rest keep all theirs."""
    placed = occurrences(docs, min_code_points)
    spanning = _spanning(placed.mapInArrow(_ends, "hi long, lo long, n long, top long, low long").collect())
    marks = placed.mapInArrow(_marks(spanning, min_documents), "doc_id long, sig long, place int")
    gone = marks.groupBy("doc_id", "sig").agg(F.collect_set("place").alias("gone"))
    counts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("l_id"), F.xxhash64("text").alias("l_sig"), line_count(F.col("text")).alias("n_lines"))
    sized = gone.join(counts, (F.col("doc_id") == F.col("l_id")) & (F.col("sig") == F.col("l_sig"))).dropDuplicates(["doc_id", "sig"])
    return sized.select("doc_id", "sig", F.size("gone").cast("long").alias("n_dropped"), _bitmap("n_lines", "gone").alias("keep"))


def kept_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_dropped`` and ``kept_text`` of every row of ``docs``."""
    rows = docs.select("doc_id", F.col("text"), F.xxhash64("text").alias("r_sig"))
    keys = bitmaps.select(F.col("doc_id").alias("k_id"), F.col("sig").alias("k_sig"), "n_dropped", "keep")
    joined = rows.where("doc_id is not null").join(keys, (F.col("doc_id") == F.col("k_id")) & (F.col("r_sig") == F.col("k_sig")), "left").select(
        "doc_id", "text", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        _kept(F.when(F.col("keep").isNotNull(), F.col("text")), "keep").alias("cut"))
    every = joined.unionByName(rows.where("doc_id is null").select("doc_id", "text", F.lit(0).cast("long").alias("n_dropped"), F.lit(None).cast("string").alias("cut")))
    return every.select("doc_id", line_count(F.col("text")).alias("n_lines"), "n_dropped", F.coalesce("cut", "text", F.lit("")).alias("kept_text"))
