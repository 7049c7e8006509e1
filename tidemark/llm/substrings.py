"""Removal of repeated passages: every word covered by a window of words that starts earlier.

1. Each document gives its words, the digest of their sequence and its anchors: the smallest
   of the short word hashes inside every window, so equal windows have equal anchors.
   Documents whose whole sequence occurs under a smaller id are removed by that alone.
2. Windows whose anchor occurs in one place only cannot repeat. The others are candidates.
3. Tasks stream their documents' candidate passages, in id order, through the suffix
   automaton of a bounded reference shard, the passages streamed before: its matching
   statistics tell which windows were seen in the shard, and those are not sent on.
4. Windows new to their shard meet across shards by 96-bit digest, with partial minima before the
   shuffle, so a passage of any frequency is one row per task. A candidate window that is
   not the first of its kind by (id, start) removes the words it covers.

Streaming every document through the automata of all shards would be quadratic in the
corpus, so shards meet through step 4; see the README.

Defined results: null texts have no words; a document shorter than a window loses nothing;
rows without an id lose nothing and are compared with nothing; repeated rows (same id and
words) are one document; rows of one id with different words are compared by (id, start)
like parts of one document; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, mix64, slices

WINDOW, SHORT, SHARD_WORDS = 20, 5, 50_000


class SuffixAutomaton:
    """Online suffix automaton over integers."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def extend(self, symbols: list[int]) -> list[int]:
        """Append symbols; for each, the length of the longest suffix ending there that was seen before."""
        moves, link, length, last = self.next, self.link, self.length, self.last
        seen = []
        for symbol in symbols:
            new, at = len(moves), last
            moves.append({})
            length.append(length[at] + 1)
            link.append(0)
            while at != -1 and symbol not in moves[at]:
                moves[at][symbol] = new
                at = link[at]
            if at != -1:
                to = moves[at][symbol]
                if length[at] + 1 == length[to]:
                    link[new] = to
                else:
                    twin = len(moves)
                    moves.append(moves[to].copy())
                    length.append(length[at] + 1)
                    link.append(link[to])
                    while at != -1 and moves[at].get(symbol) == to:
                        moves[at][symbol] = twin
                        at = link[at]
                    link[to] = link[new] = twin
            last = new
            seen.append(length[link[new]])
        self.last = last
        return seen


class Hasher:
    """64-bit hashes of words, the same in every process."""

    def __call__(self, found: list[str] | np.ndarray) -> np.ndarray:
        return pd.util.hash_array(np.asarray(found, object), categorize=False)


def _coded(texts: pa.Array, hasher: Hasher) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of all texts in one array, the bounds of each text's words in it, and their hashes.

    Arrow's ASCII white space is the set of six characters that separate words. A distinct word is hashed once.
    """
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, bounds = split.flatten(), split.offsets.to_numpy()
    filled = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at an end leaves an empty part
    flat, bounds = flat.filter(pa.array(filled)), np.concatenate([[0], np.cumsum(filled)])[bounds - bounds[0]]
    coded = flat.dictionary_encode()
    return flat, bounds, hasher(coded.dictionary.to_numpy(zero_copy_only=False))[coded.indices.to_numpy()]


def _joined(flat: pa.Array, bounds: np.ndarray) -> pa.Array:
    """Each text's words with one space between."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat), " ")


def _runs(h: np.ndarray, size: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words."""
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = out * np.uint64(factor) + h[i:i + n]
    return mix64(out)


def _digests(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Digest of every window in 96 bits: a long and, by another factor, an int."""
    return _runs(h, window).view(np.int64), (_runs(h, window, 0xD1342543DE82EF95) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _window_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest value of every ``width`` consecutive ones, by doubling."""
    places, done = np.arange(len(values)), 1
    while done < width:
        step = min(done, width - done)
        left, right = places[:len(places) - step], places[step:]
        places = np.where(values[right] < values[left], right, left)
        done += step
    return places


def _windows(h: np.ndarray, bounds: np.ndarray, window: int, short: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows that lie within one text, the text of each, and the places and hashes of their anchors.

    A window's anchor is the first of its smallest short runs. ``h`` holds the words of consecutive texts.
    """
    if len(h) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    count = np.diff(bounds)
    starts = np.flatnonzero(np.arange(window, len(h) + 1) <= np.repeat(bounds[1:], count)[:len(h) - window + 1])
    rows = np.repeat(np.arange(len(count)), np.maximum(count - window + 1, 0))
    runs = _runs(h, short)
    places = _window_least(runs, window - short + 1)[starts]
    return starts, rows, places, runs[places]


def _anchors(h: np.ndarray, bounds: np.ndarray, window: int, short: int) -> pa.Array:
    """Anchors of each text; one that stands in several places is given twice, as it repeats already.

    Equal windows of one text have equal anchors in different places.
    """
    _, rows, places, anchors = _windows(h, bounds, window, short)
    new = np.flatnonzero(np.diff(places, prepend=-1))
    rows, anchors = rows[new], anchors[new]
    order = np.lexsort((anchors, rows))
    rows, anchors = rows[order], anchors[order]
    kept = np.ones(len(rows), bool)
    kept[2:] = (rows[2:] != rows[:-2]) | (anchors[2:] != anchors[:-2])
    ends = np.searchsorted(rows[kept], np.arange(len(bounds)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(anchors[kept].view(np.int64)))


def _described(docs: DataFrame, window: int, short: int) -> DataFrame:
    def run(batches):
        hasher = Hasher()
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            for a, b in slices(lengths, 1_000_000):
                part = batch.slice(a, b - a)
                flat, bounds, h = _coded(part.column("text"), hasher)
                sha = [hashlib.sha256(t).digest() for t in _joined(flat, bounds).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(sha, pa.binary()), _anchors(h, bounds, window, short)],
                    names=["doc_id", "n_words", "sha", "anchors"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_words long, sha binary, anchors array<long>")


def _packed(docs: DataFrame) -> DataFrame:
    """``t_id`` and the text compressed: texts are shuffled twice, and most of that is their size."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                packed = [None if t is None else press.compress(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("t_id"), pa.array(packed, pa.binary())], names=["t_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("t_id"), "text").mapInArrow(run, "t_id long, text binary")


def _unpacked(batch: pa.RecordBatch):
    """First row and texts of consecutive parts of a batch of packed rows, about 2 MB of text each."""
    press, start, held, size = zstandard.ZstdDecompressor(), 0, [], 0
    for i, packed in enumerate(batch.column("text").to_pylist()):
        held.append(None if packed is None else press.decompress(packed))
        size += len(held[-1] or b"")
        if size > 2_000_000 or i + 1 == batch.num_rows:
            yield start, pa.array(held, pa.binary()).view(pa.string())
            start, held, size = i + 1, [], 0


def _passages(batch: pa.RecordBatch, hasher: Hasher, window: int, short: int):
    """For each part of a batch: its first row, the words, bounds and word hashes of its texts, and the starts and rows of candidate windows.

    An anchor that repeats is among those of every text it stands in, so one set serves all texts of a part.
    """
    for start, texts in _unpacked(batch):
        flat, bounds, h = _coded(texts, hasher)
        repeated = np.unique(batch.column("repeated").slice(start, len(texts)).flatten().to_numpy())
        starts, rows, places, anchors = _windows(h, bounds, window, short)
        new = np.flatnonzero(np.diff(places, prepend=-1))
        held = np.repeat(np.isin(anchors[new], repeated.view(np.uint64)), np.diff(new, append=len(places)))
        yield start, flat, bounds, h, starts[held], rows[held]


def _fresh_windows(passages: DataFrame, window: int, short: int, shard_words: int) -> DataFrame:
    """Digest, id and start of every candidate window not seen before in its task's shard."""

    def run(batches):
        hasher, shard, held, separator, before = Hasher(), SuffixAutomaton(), 0, 0, np.zeros(0, np.int64)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            known = np.concatenate([before, ids])
            again = (np.diff(known, prepend=known[:1] - 1) == 0)[len(before):]
            before = known[-1:]
            for at, _, bounds, h, starts, rows in _passages(batch, hasher, window, short):
                if not len(starts):
                    continue
                codes, seen = h.tolist(), []
                edge = np.flatnonzero(np.diff(starts) > 1)  # the last starts of a text are no windows: passages end there
                opens, ends = np.concatenate([[0], edge + 1]), np.concatenate([edge, [-1]])
                for first, last, anew in zip(starts[opens].tolist(), starts[ends].tolist(), again[at + rows[opens]].tolist()):
                    if held > shard_words or anew:  # texts of one id are not in the order of (id, start)
                        shard, held = SuffixAutomaton(), 0
                    separator -= 1  # matches never cross passages: no word hash is negative
                    stretch = codes[first:last + window]
                    seen += shard.extend([separator, *stretch])[window:]
                    held += len(stretch)
                new = np.array(seen) < window
                starts, rows = starts[new], rows[new]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(d[starts]) for d in _digests(h, window)], pa.array(ids[at + rows]), pa.array(starts - bounds[rows], pa.int32())],
                    names=["digest", "more", "doc_id", "start"])

    return passages.sortWithinPartitions("doc_id").mapInArrow(run, "digest long, more int, doc_id long, start int")


def _cut(passages: DataFrame, window: int, short: int) -> DataFrame:
    """Removed words and kept text of documents that lose some, given the first windows of each."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for at, flat, bounds, h, starts, rows in _passages(batch, hasher, window, short):
                part = batch.slice(at, len(bounds) - 1)
                firsts = part.column("firsts")
                repeats = np.zeros(len(h) + 1, bool)
                repeats[starts] = True
                count = pc.fill_null(pc.list_value_length(firsts), 0).to_numpy(zero_copy_only=False)
                packed = firsts.flatten().to_numpy()
                first = np.repeat(bounds[:-1], count) + (packed >> 32)
                within = first + window <= np.repeat(bounds[1:], count)
                first, more = first[within], packed[within].astype(np.int32)
                if len(first):  # another text of the same id may have the first window
                    repeats[first[_digests(h, window)[1][first] == more]] = False
                starts = np.flatnonzero(repeats)
                edges = np.zeros(len(h) + 1, np.int64)
                edges[starts] += 1
                edges[starts + window] -= 1
                kept = np.cumsum(edges)[:-1] == 0
                left = np.concatenate([[0], np.cumsum(kept)])[bounds]
                removed = np.diff(bounds) - np.diff(left)
                changed = pa.array(removed > 0)
                sha = [hashlib.sha256(t).digest() for t in _joined(flat, bounds).filter(changed).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").filter(changed), pa.array(sha, pa.binary()), pa.array(removed, pa.int64()).filter(changed),
                     _joined(flat.filter(pa.array(kept)), left).filter(changed)],
                    names=["doc_id", "sha", "n_removed", "kept_text"])

    return passages.mapInArrow(run, "doc_id long, sha binary, n_removed long, kept_text string")


def without_repeats(docs: DataFrame, window: int = WINDOW, short: int = SHORT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` of every row, and ``kept_text``: the
    kept words joined by single spaces, null where nothing was removed."""
    described = checkpointed(_described(docs, window, short))
    real = described.where("doc_id is not null")
    first = real.groupBy(F.col("sha").alias("first_sha")).agg(F.min("doc_id").alias("first_id"))
    marked = checkpointed(real.select("doc_id", "sha", "n_words").join(first, F.col("sha") == F.col("first_sha")).select(
        "doc_id", "sha", ((F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= window)).alias("copy")).distinct())
    anchors = real.select("doc_id", F.explode("anchors").alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    repeated = anchors.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("repeated"))
    sought = repeated.join(marked.where("not copy").select(F.col("doc_id").alias("o_id")), F.col("doc_id") == F.col("o_id"), "left_semi")
    # Used twice below in one plan: both uses read the same shuffle, and the second join finds it placed by id.
    passages = _packed(docs).join(sought, F.col("t_id") == F.col("doc_id")).select("doc_id", "text", "repeated")
    new = _fresh_windows(passages, window, short, shard_words)
    firsts = new.groupBy("digest", "more").agg(F.min(F.struct("doc_id", "start")).alias("at")).groupBy(
        F.col("at.doc_id").alias("f_id")).agg(
        F.collect_list(F.shiftleft(F.col("at.start").cast("long"), 32).bitwiseOR(F.col("more").cast("long").bitwiseAND(0xFFFFFFFF))).alias("firsts"))
    cut = _cut(passages.join(firsts, F.col("doc_id") == F.col("f_id"), "left").select("doc_id", "text", "repeated", "firsts"), window, short)
    changed = cut.unionByName(marked.where("copy").join(
        real.select(F.col("doc_id").alias("n_id"), F.col("sha").alias("n_sha"), F.col("n_words").alias("n_removed")).distinct(),
        (F.col("doc_id") == F.col("n_id")) & (F.col("sha") == F.col("n_sha"))).select("doc_id", "sha", "n_removed", F.lit("").alias("kept_text"))).dropDuplicates(["doc_id", "sha"])
    changed = changed.select(F.col("doc_id").alias("c_id"), F.col("sha").alias("c_sha"), "n_removed", "kept_text")
    out = described.select("doc_id", "n_words", "sha").join(changed, (F.col("doc_id") == F.col("c_id")) & (F.col("sha") == F.col("c_sha")), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                      F.coalesce(F.sha2("kept_text", 256), F.lower(F.hex("sha"))).alias("kept_sha256"), "kept_text")
