"""Collocations, the Merkle manifest and repeated lines against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import collocations, lines, manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, a long, c1 string, hi string, row string, node string, n string, rank string"
LOWER = {i: i + 32 for i in range(65, 91)}


def extended(rows):
    """Rows with columns whose names clash with those the operators use inside."""
    return [(*r, 7, "x", None, "y", "z", "n", "") for r in rows]


# ---- repeated lines

def line_rows(seed=2, n=150):
    rng = random.Random(seed)
    common = [f"This Line number {i} is long enough to be a key of its own" for i in range(12)] + ["é" * 40, "É" * 39, "a" * 40, "A" * 40, "b" * 39]
    rows = []
    for i in range(n):
        found = [rng.choice(["", "short", f"only here {i} " * 5, " \t" + rng.choice(common) + "\x0b ", rng.choice(common[:3]).upper(), "the hot line that stands in nearly every document of all"])
                 for _ in range(rng.randrange(0, 12))]
        rows.append((i * 3 % 151, "\n".join(found), "en", "s", i))
    rows += [(500, None, "en", "s", 1), (501, "", "en", "s", 1), (502, "\n", None, None, None), rows[4], rows[4], (None, "\n".join(common), "en", "s", 1),
             (504, ("\n".join(common) + "\n") * 400, "en", "s", 1), (rows[7][0], "another text\n" + common[0], "en", "s", 1)]
    return rows


def lines_brute(rows, minimum):
    holders = defaultdict(set)
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= 40:
                holders[key(line)].add(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        found = (text or "").split("\n")
        gone = [doc_id is not None and len(holders.get(key(x), ())) >= minimum and max(holders[key(x)]) != doc_id for x in found]
        out.append((doc_id, len(found), sum(gone), "\n".join(x for x, g in zip(found, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("minimum", [1, 5, 40])
def test_repeated_lines(spark, minimum):
    rows = line_rows()
    docs = spark.createDataFrame(extended(rows), SCHEMA).repartition(3)
    got = lines.kept_lines(docs, lines.keep_bitmaps(docs, min_documents=minimum)).collect()
    assert sorted((tuple(r) for r in got), key=str) == lines_brute(rows, minimum)


def test_a_line_over_many_partitions(spark):
    """The hot line fills several range partitions and several batches of each."""
    rows = [(i, "the hot line that stands in every document of this table\nrow " + str(i), "en", "s", 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = lines.occurrences(docs)
        ends = placed.mapInArrow(lines._ends, "hi long, lo long, n long, top long, low long").collect()
        assert len(ends) > 4 and set(lines._spanning(ends).values()) == {(3000, 2999)}
        got = {r.doc_id: (r.n_dropped, r.keep) for r in lines.keep_bitmaps(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(got) == set(range(2999))
    assert all(n == 1 and zlib.decompress(keep) == b"\x40" for n, keep in got.values())


def test_lines_of_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert lines.kept_lines(docs, lines.keep_bitmaps(docs)).collect() == []


# ---- manifest

def manifest_rows():
    rng = random.Random(1)
    rows = [(i * 7 % 701, rng.choice([None, "", "AbC é Ü", "hello World" * 3]), rng.choice(["en", None]),
             rng.choice(["a"] * 30 + ["b", "b", None, "", "c", "z9"]) if i < 650 else f"s{i}", i) for i in range(700)]
    return rows + [rows[0], rows[0], (None, "X", "en", "a", 3), (3, "another", "en", "a", None)]


def joined(digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return joined("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([joined(out[-1][i:i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def proofs_brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    held = {s: sorted(by[s], key=lambda x: x[:3]) for s in sources}
    trees = {s: levels([x[2] for x in held[s]]) for s in sources}
    over = levels([trees[s][-1][0] for s in sources])
    out = []
    for i, s in enumerate(sources):
        for p, (_, _, leaf, r) in enumerate(held[s]):
            folded, proof = leaf, ""
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                folded = leaf_of(r[0], r[1].translate(LOWER), *r[2:])
            for tree, at in ((trees[s], p), (over, i)):
                for level in tree[:-1]:
                    run, k = level[at // 16 * 16:at // 16 * 16 + 16], at % 16
                    proof += "".join(run[:k] + run[k + 1:])
                    folded, at = joined(run[:k] + [folded] + run[k + 1:]), at // 16
            out.append((r[0], leaf, trees[s][-1][0], over[-1][0], proof, folded, folded == over[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [None, 1, 20, 0])
def test_merkle_proofs(spark, size):
    rows = manifest_rows()[:size]
    got = manifest.proofs(spark.createDataFrame(extended(rows), SCHEMA).repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=str) == proofs_brute(rows)


def test_nodes_near_the_root_in_copies(spark, monkeypatch):
    monkeypatch.setattr(manifest, "COPY_LEAVES", 20)
    rows = manifest_rows()
    leaves, runs, _ = manifest.build(spark.createDataFrame(extended(rows), SCHEMA))
    assert runs.where("parent is null").count() == -(-len(rows) // 20) and leaves.count() == len(rows)
    got = manifest.proofs(spark.createDataFrame(extended(rows), SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == proofs_brute(rows)


# ---- collocations

def phrase_rows(seed=5, n=220):
    rng = random.Random(seed)
    words = ["New", "york", "the", "of", "a", "city", "times", "é", " x", "日本", "state\x1f"]
    rows = []
    for i in range(n):
        parts = [rng.choice([rng.choice(words), "new york", "new york times", "the city of york", "x", ".", ",\t", "\n", "  ", "!?"]) for _ in range(rng.randrange(0, 30))]
        rows.append((i, " ".join(parts), rng.choice(["en", "en", "fr", None, "und"]), "s", i))
    return rows + [(900, None, "en", "s", 1), (901, "", "de", "s", 1), (902, " , ", "de", "s", 1), rows[3], rows[3], (903, "new york times the " * 5000, "fr", "s", 1)]


def phrases_brute(rows, minimum, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            found = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(found)
            for k in range(1, 5):
                for i in range(len(found) - k + 1):
                    f[lang, tuple(found[i:i + k])] += 1
    f = {key: a for key, a in f.items() if a >= minimum}
    out = defaultdict(list)
    for (lang, words), a in f.items():
        if len(words) > 1:
            score, cut = min((2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words)))
            inside = any(at == lang and len(other) > len(words) and 100 * b >= 80 * a and any(other[i:i + len(words)] == words for i in range(len(other)))
                         for (at, other), b in f.items())
            if not inside:
                out[lang].append((-score, -a, " ".join(words).encode(), f[lang, words[:cut]], f[lang, words[cut:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -score)
                  for lang, found in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1))


@pytest.mark.parametrize("minimum, top", [(8, 2000), (30, 5), (10**6, 10)])
def test_collocations(spark, minimum, top):
    rows = phrase_rows()
    got = collocations.collocations(spark.createDataFrame(extended(rows), SCHEMA).repartition(3), min_count=minimum, top=top).collect()
    assert sorted(tuple(r) for r in got) == phrases_brute(rows, minimum, top)


def test_candidates_over_several_tries(spark):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    encoded, vocabulary = collocations.encoded_words(docs)
    frequent = vocabulary.where("n >= 8")
    found = collocations.candidates(encoded, frequent, 8, 5000)
    whole = collocations.phrase_counts(encoded, found, 8)
    parts = collocations.phrase_counts(encoded, found, 8, trie_phrases=25)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect())) and whole.count() > 50


def test_collocations_of_an_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_double_array_counts_every_phrase():
    rng = np.random.default_rng(4)
    codes = np.concatenate([rng.choice(rng.integers(-2**62, 2**62, 40), 6000) * (rng.random(6000) > 0.1), np.zeros(4, np.int64)])
    want = Counter(tuple(codes[i:i + k].tolist()) for k in range(1, 5) for i in range(6000) if (codes[i:i + k] != 0).all())
    held = [p for p in want if len(p) > 1][::3]
    trie = collocations.DoubleArrayTrie(np.array([p + (0,) * (4 - len(p)) for p in held], np.int64))
    total = np.zeros(len(trie.base), np.int64)
    trie.count(codes, 6000, total)
    met = np.flatnonzero(trie.end >= 0)
    got = {tuple(c for c in trie.phrases[trie.end[s]].tolist() if c): int(total[s]) for s in met}
    assert got == {p: want[p] for p in held}


def test_words_with_one_code_are_reported(monkeypatch):
    monkeypatch.setattr(collocations.xxhash, "xxh3_64_intdigest", lambda word, seed=0: len(word))
    coder = collocations.Coder("en", 0)
    assert coder([b"ab", b"cd", b"\xff", b"abc"]).tolist()[2] == 0 and [w for _, w in coder.clashes] == [b"cd"]
