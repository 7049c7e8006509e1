"""Collocations: phrases of two to four words that stand together more often than apart.

1. One pass splits the texts and writes slices of word codes: 64-bit digests of language and
   word, zero between pieces, compressed. The same pass counts words. Two words with one code
   are found by grouping, and the pass is repeated with another seed, so codes are exact.
2. Candidates are Apriori-safe. A phrase of k words counts only where both its parts of k - 1
   words are still alive. The alive parts stand in a bit set of fixed size, whose false
   positives only let more through. Digests of the phrases are counted per task, packed by
   ranges and summed; those that reach the threshold stay, an upper bound of a phrase's count.
3. Candidates are dealt over shards of bounded size. A shard becomes a double-array trie that
   is broadcast; numpy advances the states of all positions of a slice together, a level at a
   time, and bincounts the states it meets. The sums over tasks are the exact counts.
4. Scores, the drop of phrases inside longer ones and the ranks are joins of counts.

Nothing broadcast or collected grows with the corpus: a bit set of ``FILTER_BITS`` bits and a
trie of about ``TRIE_PHRASES`` phrases at a time. More candidates make more passes over the codes.

Defined results: null texts are empty; a null language counts as ``und``, together with rows
that say so; punctuation and line breaks end a phrase, and so does the end of a text; repeated
rows count each time; ties of score and count rank by the phrase's bytes; a language without
candidates has no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import blocks_for, checkpointed, mix64, slices

MIN_COUNT, MAX_WORDS, TOP, COVER = 30, 4, 2000, 80
FILTER_BITS, TRIE_PHRASES = 25, 400_000
SLICE_TOKENS, CUT_BYTES, MERGE_KEYS, RANGE_WORDS, COUNT_BLOCK = 1_000_000, 4_000_000, 2_000_000, 4_000_000, 10_000
LOW_CODE = (1 << 32) - 1
# A byte that no UTF-8 text holds stands for the end of a piece.
_END = b"\xff"
# A-Z lower-cased, tab as space, punctuation and line breaks as the end of a piece.
_BYTES = bytes(0xFF if b in b".,;:!?\x0a\x0b\x0c\x0d" else b + 32 if 65 <= b <= 90 else 32 if b == 9 else b for b in range(256))
CODES = [f"c{i + 1}" for i in range(MAX_WORDS)]


def tokens(text: bytes):
    """Words of a text with an end mark between pieces, some megabytes of text at a time."""
    text = text.translate(_BYTES)
    start = 0
    while start < len(text):
        cut = text.find(b" ", start + CUT_BYTES)
        cut = len(text) if cut < 0 else cut
        yield text[start:cut].replace(_END, b" \xff ").split()
        start = cut
    yield [_END]


class Coder:
    """Codes of one language's words; zero for the end mark. Remembers words and their codes."""

    def __init__(self, lang: str, seed: int):
        self.seed = xxhash.xxh3_64_intdigest(lang.encode(), seed)
        self.forget()

    def forget(self):
        self.codes, self.words, self.clashes = {_END: 0}, {}, []

    def __call__(self, found: list[bytes]) -> np.ndarray:
        codes = list(map(self.codes.get, found))
        if None in codes:
            for i, word in enumerate(found):
                if codes[i] is None:
                    code = self.codes.get(word)
                    if code is None:
                        code = self.codes[word] = (xxhash.xxh3_64_intdigest(word, self.seed) or 1) - (1 << 63)
                        if self.words.setdefault(code, word) != word:
                            self.clashes.append((code, word))
                    codes[i] = code
        return np.array(codes, np.int64)


def _encoded(docs: DataFrame, seed: int) -> DataFrame:
    """Slices of codes with the slice's words, their codes and counts (zero for a clashing word)."""

    def flushed(lang, coder, parts):
        codes = np.concatenate(parts)
        found, n = np.unique(codes, return_counts=True)
        found, n = found[found != 0], n[found != 0]
        names = [coder.words[c] for c in found.tolist()] + [w for _, w in coder.clashes]
        held = np.concatenate([found, np.array([c for c, _ in coder.clashes], np.int64)])
        counts = np.concatenate([n, np.zeros(len(coder.clashes), np.int64)])
        packed = zstandard.ZstdCompressor(level=1).compress(codes.tobytes())
        if len(coder.codes) > 300_000 or coder.clashes:
            coder.forget()
        return pa.RecordBatch.from_arrays(
            [pa.array([lang], pa.string()), pa.array([packed], pa.binary()), pa.array([[w.decode() for w in names]], pa.list_(pa.string())),
             pa.array([held], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64()))], names=["lang", "packed", "words", "codes", "counts"])

    def run(batches):
        coders: dict[str, Coder] = {}
        parts: dict[str, list[np.ndarray]] = {}
        held = 0
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            for a, b in slices(lengths, CUT_BYTES):
                by_lang: dict[str, list[bytes]] = {}
                for lang, text in zip(batch.column("lang")[a:b].to_pylist(), batch.column("text")[a:b].cast(pa.binary()).to_pylist()):
                    by_lang.setdefault(lang, []).append(text)
                for lang, texts in by_lang.items():
                    coder = coders.setdefault(lang, Coder(lang, seed))
                    for found in tokens(_END.join(texts)):
                        parts.setdefault(lang, []).append(coder(found))
                        held += len(found)
                if held > SLICE_TOKENS or len(coders) > 1000:
                    for at, done in parts.items():
                        yield flushed(at, coders[at], done)
                    parts, held = {}, 0
                    if len(coders) > 1000:
                        coders = {}
        for at, done in parts.items():
            yield flushed(at, coders[at], done)

    return docs.where("text is not null").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(
        run, "lang string, packed binary, words array<string>, codes array<long>, counts array<long>")


def _windows(packed: pa.Array):
    """Codes of every slice in bounded stretches, each with the words that phrases starting in it reach."""
    for cell in packed:
        codes = np.frombuffer(zstandard.ZstdDecompressor().decompress(cell.as_py()), np.int64)
        for start in range(0, len(codes), SLICE_TOKENS):
            starts = min(SLICE_TOKENS, len(codes) - start)
            yield np.concatenate([codes[start:start + starts + MAX_WORDS - 1], np.zeros(MAX_WORDS, np.int64)])[:starts + MAX_WORDS], starts


def _vocabulary(encoded: DataFrame) -> DataFrame:
    """Counts of all words by language, word and code."""
    rows = encoded.select("lang", F.explode(F.arrays_zip("words", "codes", "counts")).alias("w"))
    return rows.groupBy("lang", F.col("w.words").alias("word"), F.col("w.codes").alias("code")).agg(F.sum("w.counts").alias("n"))


def encoded_words(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Slices of codes, and all words with codes and counts; no two words share a code."""
    seed = 0
    while True:
        encoded = checkpointed(_encoded(docs, seed))
        vocabulary = checkpointed(_vocabulary(encoded))
        if vocabulary.groupBy("code").agg(F.count(F.lit(1)).alias("words")).where("words > 1").isEmpty():
            return encoded, vocabulary
        seed += 1


def key_bits(words: int) -> int:
    """Leading bits of a digest that a phrase is counted by: about a thousand values per word of the corpus.

    Phrases that share them only raise each other's bound.
    """
    return min(60, max(FILTER_BITS, max(1, words).bit_length() + 10))


def _filter_bits(keys: DataFrame, bits: int) -> np.ndarray:
    """Bit set of the leading ``FILTER_BITS`` bits of ``key``, at most that many bits whatever the number of keys."""
    lead = F.shiftright("key", bits - FILTER_BITS)
    rows = keys.select(F.shiftright(lead, 15).alias("block"), lead.bitwiseAND(F.lit(32767)).alias("bit")).groupBy("block").agg(
        F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in rows:
        out[r.block * 4096:(r.block + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _leading(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def _alive(keys: np.ndarray, held: np.ndarray) -> np.ndarray:
    lead = _leading(keys, FILTER_BITS)
    return (held[lead >> 3] >> (lead & 7).astype(np.uint8)) & 1 > 0


def _next_keys(keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Digest of a phrase from the digest of all but its last word, and that word."""
    with np.errstate(over="ignore"):
        return mix64(keys * np.uint64(0x9E3779B97F4A7C15) + codes)


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 as compressed byte planes, so that their leading zeros cost nothing."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)


def _candidate_pass(encoded: DataFrame, k: int, shared, bits: int, buckets: int) -> DataFrame:
    """From the alive phrases of k - 1 words: their spellings, and counts of k words per task.

    Both are sorted by digest, cut into ranges and packed: ``bucket``, ``keys`` as differences,
    and ``counts`` or the spellings' ``words``, the low halves of their codes.
    """
    names = ["bucket", "keys", "counts", "words"]

    def run(batches):
        held = shared.value
        keys, counts, waiting = [], [], 0
        spelled: list[tuple[np.ndarray, np.ndarray]] = []
        borders = np.array([b * (1 << bits) // buckets for b in range(buckets + 1)], np.int64)

        def ranges(found, values):
            """Rows of sorted digests; ``values`` has a line of counts or a line per word."""
            edge = np.searchsorted(found, borders)
            full = np.flatnonzero(np.diff(edge))
            packed = [[_packed(np.diff(found[edge[b]:edge[b + 1]], prepend=0)), _packed(values[..., edge[b]:edge[b + 1]].ravel().view(np.uint64))] for b in full]
            columns = [pa.array(full, pa.int32()), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary()), pa.nulls(len(full), pa.binary())]
            return pa.RecordBatch.from_arrays(columns if values.ndim == 1 else [*columns[:2], columns[3], columns[2]], names=names)

        def spellings(parts):
            words, first = np.unique(np.concatenate([p[1] for p in parts], axis=1), axis=1, return_index=True)
            found = np.concatenate([p[0] for p in parts])[first]
            order = np.argsort(found, kind="stable")
            return ranges(found[order], words[:, order] & LOW_CODE)

        for batch in batches:
            for codes, starts in _windows(batch.column("packed")):
                plain = codes.view(np.uint64)
                key, whole = plain, codes != 0
                for j in range(1, k - 1):
                    key = _next_keys(key[:-1], plain[j:])
                    whole = whole[:-1] & (codes[j:] != 0)
                alive = whole & _alive(key, held)
                if k > 2:
                    at = np.flatnonzero(alive[:starts])
                    found, first = np.unique(key[at], return_index=True)
                    spelled.append((_leading(found, bits), np.stack([codes[at[first] + j] for j in range(k - 1)])))
                    if sum(len(f) for f, _ in spelled) > MERGE_KEYS:
                        yield spellings(spelled)
                        spelled = []
                if k <= MAX_WORDS:
                    at = np.flatnonzero(alive[:starts] & alive[1:starts + 1])
                    found, n = np.unique(_leading(_next_keys(key[at], plain[at + k - 1]), bits), return_counts=True)
                    keys.append(found)
                    counts.append(n)
                    waiting += len(found)
                    if waiting > 2 * MERGE_KEYS:
                        found, n = _merged(keys, counts)
                        keys, counts, waiting = [found], [n], len(found)
                        if waiting > MERGE_KEYS:
                            yield ranges(found, n)
                            keys, counts, waiting = [], [], 0
        if keys:
            yield ranges(*_merged(keys, counts))
        if spelled:
            yield spellings(spelled)

    return encoded.select("packed").mapInArrow(run, "bucket int, keys binary, counts binary, words binary")


def _counted(k: int, min_count: int):
    """Of a range: digests of k words that are counted ``min_count`` times over all tasks (codes null), and the spellings of k - 1 words, once each."""

    def run(table: pa.Table) -> pa.Table:
        keys, counts, words = (table.column(c).to_pylist() for c in ("keys", "counts", "words"))
        held = [np.zeros(0, np.int64)]
        if any(c is not None for c in counts):
            found, n = _merged([np.cumsum(_unpacked(x)) for x, c in zip(keys, counts) if c is not None], [_unpacked(c) for c in counts if c is not None])
            held = [found[n >= min_count]]
        spelled = np.zeros((MAX_WORDS, 0), np.int64)
        if any(w is not None for w in words):
            given = np.concatenate([np.concatenate([np.cumsum(_unpacked(x))[None], _unpacked(w).reshape(k - 1, -1)]) for x, w in zip(keys, words) if w is not None], axis=1)
            given = np.unique(given, axis=1)
            held.append(given[0])
            spelled = np.concatenate([given[1:], np.zeros((MAX_WORDS - k + 1, given.shape[1]), np.int64)])
        empty = pa.nulls(len(held[0]), pa.int64())
        return pa.table({"key": pa.array(np.concatenate(held), pa.int64()), **{
            c: pa.chunked_array([empty, pa.array(spelled[i], pa.int64())]) for i, c in enumerate(CODES)}})

    return run


def _whole_codes(spelled: DataFrame, frequent: DataFrame, words: int) -> DataFrame:
    """Codes from their low halves: those of every frequent word that has it, so one phrase may become several candidates."""
    codes = frequent.select(F.col("code").bitwiseAND(F.lit(LOW_CODE)).alias("low"), F.col("code").alias("full"))
    for c in CODES[:words]:
        spelled = spelled.join(codes, F.col(c) == F.col("low")).drop(c, "low").withColumnRenamed("full", c)
    return spelled.select(*CODES)


def candidates(encoded: DataFrame, frequent: DataFrame, min_count: int, words: int) -> DataFrame:
    """Codes ``c1`` to ``c4`` (zero beyond the last) of every phrase that may stand ``min_count`` times.

    ``words`` is the size of the corpus; it sets the length of digests and the number of ranges.
    """
    spark = encoded.sparkSession
    bits, buckets = key_bits(words), max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks_for(words, RANGE_WORDS))
    # Codes are signed; as unsigned numbers their leading bits sort and filter like the digests'.
    alive = frequent.select(F.shiftrightunsigned("code", 64 - bits).alias("key"))
    out = None
    for k in range(2, MAX_WORDS + 2):
        shared = spark.sparkContext.broadcast(_filter_bits(alive, bits))
        found = checkpointed(_candidate_pass(encoded, k, shared, bits, buckets).groupBy("bucket").applyInArrow(
            _counted(k, min_count), "key long, " + ", ".join(f"{c} long" for c in CODES)))
        shared.unpersist()
        if k > 2:
            spelled = _whole_codes(found.where("c1 is not null").join(alive, "key", "left_semi").select(*CODES).distinct(), frequent, k - 1)
            out = spelled if out is None else out.unionByName(spelled)
        alive = found.where("c1 is null").select("key")
    return checkpointed(out)


class DoubleArrayTrie:
    """Phrases of codes as a double array: the child of state s by symbol x is ``base[s] + x`` if ``check`` there is s.

    A word's number is two symbols, quotient and remainder by ``radix``, so families of children
    stay within ``radix`` slots and pack well. State 0 is the root; symbols count from 1.
    """

    def __init__(self, phrases: np.ndarray):
        self.phrases = phrases[np.lexsort(phrases.T[::-1])]
        self.codes = np.unique(phrases[phrases != 0])
        self.radix = 1 << -(-max(1, len(self.codes).bit_length()) // 2)
        number = np.searchsorted(self.codes, self.phrases)
        digits = np.stack([number // self.radix + 1, number % self.radix + 1], axis=2) * (self.phrases != 0)[:, :, None]
        symbols = digits.reshape(len(self.phrases), 2 * MAX_WORDS)
        # Slots start beyond the largest symbol, so every base is positive.
        self.gap = self.radix + 2
        self.base, self.check, self.used = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, bool)
        self._reach(4 * self.gap)
        self.used[:self.gap] = True
        state = np.zeros(len(symbols), np.int64)
        for depth in range(2 * MAX_WORDS):
            inside = np.flatnonzero(symbols[:, depth])
            if not len(inside):
                break
            edges, at = np.unique(state[inside] * self.gap + symbols[inside, depth], return_inverse=True)
            state[inside] = self._placed(edges // self.gap, edges % self.gap)[at]
        self._reach(len(self.used) + self.gap)
        self.end = np.full(len(self.base), -1, np.int32)
        self.end[state] = np.arange(len(state))
        del self.used

    def _reach(self, size: int):
        more = max(0, int(size) - len(self.base))
        self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
        self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])
        self.used = np.concatenate([self.used, np.zeros(more, bool)])

    def _placed(self, parent: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """States of the children, given as sorted (parent, symbol).

        Families that fill a quarter of their span are put in a row. The others are placed from
        the largest size down: each round draws a base for every family left, and those whose
        slots are free and not drawn by an earlier family stay. There is room enough that about
        one draw in a hundred fits. Single children take the slots that are left.
        """
        starts = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        size = np.diff(np.append(starts, len(parent)))
        out = np.empty(len(parent), np.int64)
        draw = np.random.default_rng(0)

        def settle(families, base, slot, family, child):
            out[child] = slot
            self.used[slot] = True
            self.base[parent[starts[families]]] = base

        def children(families):
            family = np.repeat(np.arange(len(families)), size[families])
            before = np.concatenate([[0], np.cumsum(size[families])[:-1]])
            return family, np.repeat(starts[families] - before, size[families]) + np.arange(len(family))

        full = np.flatnonzero(size >= self.radix // 4 + 2)
        if len(full):
            first, last = symbol[starts[full]], symbol[starts[full] + size[full] - 1]
            ends = len(self.base) + np.cumsum(last - first + 1)
            base = np.concatenate([[len(self.base)], ends[:-1]]) - first
            self._reach(ends[-1])
            family, child = children(full)
            settle(full, base, base[family] + symbol[child], family, child)
        for low in [1 << k for k in range(self.radix.bit_length(), 0, -1)]:
            left = np.flatnonzero((size >= low) & (size < 2 * low) & (size < self.radix // 4 + 2))
            if not len(left):
                continue
            share = 1 - 100 ** (-1 / (1.5 * low))
            self._reach((self.used.sum() + size[left].sum()) / share + 2 * self.gap)
            while len(left):
                base = draw.integers(self.gap, len(self.base) - self.gap, len(left)) - symbol[starts[left]]
                family, child = children(left)
                slot = base[family] + symbol[child]
                _, first = np.unique(slot, return_index=True)
                late = np.ones(len(slot), bool)
                late[first] = False
                failed = np.zeros(len(left), bool)
                failed[family[late | self.used[slot]]] = True
                good = ~failed[family]
                settle(left[~failed], base[~failed], slot[good], family[good], child[good])
                left = left[failed]
        single = starts[size == 1]
        self._reach(len(self.used) + max(0, len(single) - np.count_nonzero(~self.used)))
        free = np.flatnonzero(~self.used)[:len(single)]
        out[single] = free
        self.used[free] = True
        self.base[parent[single]] = free - symbol[single]
        self.check[out] = parent
        return out

    def count(self, codes: np.ndarray, starts: int, total: np.ndarray):
        """Add how often each state is met by phrases that start at the first ``starts`` positions."""
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        known = self.codes[at] == codes
        symbols = [np.where(known, at // self.radix + 1, 0), at % self.radix + 1]
        place, state = np.flatnonzero(known[:starts]), np.zeros(np.count_nonzero(known[:starts]), np.int64)
        for depth in range(2 * MAX_WORDS):
            following = self.base[state] + symbols[depth % 2][place + depth // 2]
            kept = self.check[following] == state
            place, state = place[kept], following[kept].astype(np.int64)
            if depth % 2:
                total += np.bincount(state, minlength=len(total))


def _counting_pass(encoded: DataFrame, shared) -> DataFrame:
    """Counts of the trie's phrases per task, packed in blocks of phrases."""

    def run(batches):
        trie = shared.value
        total = np.zeros(len(trie.base), np.int64)
        for batch in batches:
            for codes, starts in _windows(batch.column("packed")):
                trie.count(codes, starts, total)
        counts = np.zeros(len(trie.phrases), np.int64)
        ends = np.flatnonzero(trie.end >= 0)
        counts[trie.end[ends]] = total[ends]
        blocks = [(b, _packed(counts[at:at + COUNT_BLOCK])) for b, at in enumerate(range(0, len(counts), COUNT_BLOCK)) if counts[at:at + COUNT_BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in blocks], pa.int32()), pa.array([c for _, c in blocks], pa.binary())], names=["block", "counts"])

    return encoded.select("packed").mapInArrow(run, "block int, counts binary")


def _summed(shared, min_count: int):
    """Phrases of a block with their counts over all tasks."""

    def run(table: pa.Table) -> pa.Table:
        total = sum(_unpacked(x.as_py()) for x in table.column("counts"))
        met = np.flatnonzero(total >= min_count)
        phrases = shared.value.phrases[table.column("block")[0].as_py() * COUNT_BLOCK + met]
        return pa.table({**{c: pa.array(phrases[:, i], pa.int64()) for i, c in enumerate(CODES)}, "a": pa.array(total[met], pa.int64())})

    return run


def phrase_counts(encoded: DataFrame, found: DataFrame, min_count: int, trie_phrases: int = TRIE_PHRASES) -> DataFrame:
    """Codes and exact count ``a`` of the candidates that stand ``min_count`` times, one bounded trie at a time."""
    context = encoded.sparkSession.sparkContext
    shards = blocks_for(found.count(), trie_phrases)
    schema = ", ".join(f"{c} long" for c in CODES) + ", a long"
    out = None
    for shard in range(shards):
        held = found.where(F.pmod(F.xxhash64(*CODES), F.lit(shards)) == shard).toArrow()
        if not held.num_rows:
            continue
        shared = context.broadcast(DoubleArrayTrie(np.stack([held.column(c).to_numpy() for c in CODES], axis=1)))
        counts = checkpointed(_counting_pass(encoded, shared).groupBy("block").applyInArrow(_summed(shared, min_count), schema))
        shared.unpersist()
        out = counts if out is None else out.unionByName(counts)
    return encoded.sparkSession.createDataFrame([], schema) if out is None else out


def _spelled(counts: DataFrame, frequent: DataFrame) -> DataFrame:
    """``lang``, ``words``, ``phrase`` and ``a``."""
    places = counts.select(*CODES, "a", F.posexplode(F.array_remove(F.array(*CODES), 0)).alias("i", "code"))
    named = places.join(frequent.select("code", "lang", "word"), "code")
    whole = named.groupBy(*CODES, "a").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("i", "word"))).alias("found"))
    words = whole.select("lang", F.transform("found", lambda x: x["word"]).alias("words"), "a")
    return words.select("lang", "words", F.array_join("words", " ").alias("phrase"), "a")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, cover: int = COVER) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score`` of each language's best phrases."""
    encoded, vocabulary = encoded_words(docs)
    totals = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = checkpointed(vocabulary.where(F.col("n") >= min_count))
    words = totals.agg(F.sum("n")).first()[0] or 0
    counts = phrase_counts(encoded, candidates(encoded, frequent, min_count, words), min_count)
    found = checkpointed(_spelled(counts, frequent))
    f = frequent.select("lang", F.col("word").alias("part"), F.col("n").alias("f")).unionByName(
        found.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")))
    cuts = found.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("head"),
        F.array_join(F.slice("words", F.col("cut") + 1, F.size("words")), " ").alias("tail"))
    cut = cuts.join(f.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(
        f.select("lang", F.col("part").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    # Exact: the product may pass 64 bits, so it is a decimal.
    score = F.expr("cast(a as decimal(20, 0)) * 2000000 div (l + r)")
    scored = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    parts = found.where(F.size("words") > 2).select("lang", "words", "a", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("k")).select(
        "lang", "words", "a", "k", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("k") + 1)).alias("from"))
    longer = parts.groupBy("lang", F.array_join(F.slice("words", F.col("from"), F.col("k")), " ").alias("phrase")).agg(F.max("a").alias("longer"))
    wide = "decimal(20, 0)"
    kept = scored.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer").cast(wide) * 100 < F.col("a").cast(wide) * cover))
    best = W.partitionBy("lang").orderBy(F.col("low.score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), "n", F.col("low.score").alias("score"))
