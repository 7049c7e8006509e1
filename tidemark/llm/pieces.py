"""Subword encoding with byte offsets into the original text, and decoding.

A text is normalised by the model's compiled character map: at every place the longest
mapped prefix is replaced, all else is copied, and each normalised byte remembers the span
of original bytes it came from. The library segments the normalised text with its own
normalisation switched off, and every piece is projected back through the alignment to a
span of original bytes. Ids equal those of the sentencepiece library on the original text
with begin and end ids and no sampling.

Defined results: a null text counts as empty (begin and end id only, decoded to "");
existing columns named like an output column are replaced; repeated rows are encoded alike.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import slices

SPACE = "▁"
# Text bytes encoded at a time by a worker.
SLICE_BYTES = 1_000_000


def character_map(blob: bytes) -> dict[str, str]:
    """Source -> replacement of a compiled character map (a double-array trie and its strings)."""
    if not blob:
        return {}
    (trie_bytes,) = struct.unpack_from("<I", blob)
    units, labels = np.frombuffer(blob, "<u4", trie_bytes // 4, 4), np.arange(1, 256)
    strings = blob[4 + trie_bytes:]

    def jump(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    found, stack = {}, [(jump(int(units[0])), b"")]
    while stack:
        base, prefix = stack.pop()
        at = base ^ labels
        at = np.where(at < len(units), at, 0)
        for label in labels[(units[at] & 0x800000FF) == labels].tolist():
            at = base ^ label
            unit = int(units[at])
            source, below = prefix + bytes([label]), at ^ jump(unit)
            if unit & 0x100:
                offset = int(units[below]) & 0x7FFFFFFF
                found[source.decode()] = strings[offset:strings.index(b"\0", offset)].decode()
            stack.append((below, source))
    return found


class Normaliser:
    """Longest-prefix normalisation that keeps, per normalised byte, its original byte span."""

    def __init__(self, spec, kept_whole: list[str]):
        self.map = {**character_map(spec.precompiled_charsmap), **{s: s for s in kept_whole}}
        self.longest = max(map(len, self.map), default=0)
        firsts = "".join(sorted({s[0] for s in self.map}))
        self.starts = re.compile("[" + re.escape(firsts) + "]") if firsts else None
        self.prefix, self.trim = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.space = SPACE if spec.escape_whitespaces else " "
        self.plain = not self.map and not self.trim and spec.escape_whitespaces

    def chunks(self, text: str):
        """(source, replacement) pairs that cover the text; copied stretches are one pair."""
        at = copied = 0
        while self.starts is not None and (m := self.starts.search(text, at)):
            at = m.start()
            for length in range(min(self.longest, len(text) - at), 0, -1):
                source = text[at:at + length]
                if source in self.map:
                    if copied < at:
                        yield text[copied:at], None
                    yield source, self.map[source]
                    at += length
                    copied = at
                    break
            else:
                at += 1
        if copied < len(text):
            yield text[copied:], None

    def __call__(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        """Normalised text, and begin and end of the source of each of its bytes."""
        out, begins, ends, at = [], [], [], 0
        for source, target in self.chunks(text):
            size = len(source.encode())
            for char in source if target is None else target:
                width = len(char.encode())
                span = (at, at + width) if target is None else (at, at + size)
                out.append(char)
                begins.append(span[0])
                ends.append(span[1])
                at += width if target is None else 0
            at += size if target is not None else 0
        if self.trim:
            keep = [i for i, c in enumerate(out) if c != " " or (i > 0 and out[i - 1] != " ")]
            out, begins, ends = ([x[i] for i in keep] for x in (out, begins, ends))
        if out and self.prefix:
            out, begins, ends = [" ", *out], [begins[0], *begins], [begins[0], *ends]
        out = [self.space if c == " " else c for c in out]
        while self.trim and out and out[-1] == self.space:
            out.pop(), begins.pop(), ends.pop()
        widths = np.array([len(c.encode()) for c in out], dtype=np.int64)
        return "".join(out), np.repeat(np.array(begins, np.int64), widths), np.repeat(np.array(ends, np.int64), widths)


class Pieces:
    """One model as a worker holds it."""

    def __init__(self, blob: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto.FromString(blob)
        whole = [p.piece for p in model.pieces if p.type == pb.ModelProto.SentencePiece.USER_DEFINED]
        self.normaliser = Normaliser(model.normalizer_spec, whole)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        spec = model.normalizer_spec
        # Plain joining of pieces is the library's rule only for such models.
        self.joins = not whole and spec.add_dummy_prefix and not spec.remove_extra_whitespaces
        self.prefix = spec.add_dummy_prefix
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces = b"", False, False
        self.raw = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        byte, normal = pb.ModelProto.SentencePiece.BYTE, pb.ModelProto.SentencePiece.NORMAL
        self.bytes_of, self.is_byte = [], set()
        for i, p in enumerate(model.pieces):
            if p.type == byte:
                self.is_byte.add(i)
                self.bytes_of.append(bytes([int(p.piece[3:5], 16)]))
            else:
                self.bytes_of.append(p.piece.replace(SPACE, " ").encode() if p.type == normal else b"")
        # Normalised bytes that each piece covers; an unknown piece covers what it is made for.
        self.width = np.array([1 if i in self.is_byte else len(p.piece.encode()) for i, p in enumerate(model.pieces)], np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row offsets, ids, and begin and end bytes of each piece in its original text."""
        bos, eos, unknown = self.raw.bos_id(), self.raw.eos_id(), self.raw.unk_id()
        offsets, ids, begins, ends = [0], [], [], []
        for text in texts:
            size = len(text.encode())
            if self.normaliser.plain:
                norm = (SPACE if text and self.prefix else "") + text.replace(" ", SPACE)
                width = np.where(np.frombuffer(text.encode(), np.uint8) == 32, 3, 1)
                source = np.repeat(np.arange(size), width)
                lead = np.zeros(3 if text and self.prefix else 0, np.int64)
                begin, end = np.concatenate([lead, source, [size]]), np.concatenate([lead, source + 1])
            else:
                norm, begin, end = self.normaliser(text)
                begin = np.concatenate([begin, [size]])
            found = np.array(self.raw.encode(norm), np.int64)
            until = np.cumsum(self.width[found])
            if unknown in found:
                until = np.cumsum([1 if i in self.is_byte else len(x.encode()) for i, x in zip(found, self.raw.encode(norm, out_type=str))])
            if len(found) and until[-1] != len(end):
                raise ValueError("pieces do not cover the normalised text")
            since = np.concatenate([[0], until[:-1]]).astype(np.int64) if len(found) else until
            ids += [[bos], found, [eos]]
            begins += [[0], begin[since], [size]]
            ends += [[0], end[until - 1] if len(found) else found, [size]]
            offsets.append(offsets[-1] + len(found) + 2)
        return np.array(offsets), *(np.concatenate([*x, []]).astype(np.int32) for x in (ids, begins, ends))

    def decode(self, ids: list[int]) -> str:
        """Text of ids, as the library's decode gives it."""
        first = next((i for i in ids if self.bytes_of[i]), None)
        if not self.joins or first in self.is_byte or self.raw.unk_id() in ids:
            return self.library.decode(ids)
        try:
            text = b"".join(map(self.bytes_of.__getitem__, ids)).decode()
        except UnicodeDecodeError:
            return self.library.decode(ids)
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def _pieces(blob: bytes) -> Pieces:
    return Pieces(blob)


def read_model(path: str) -> bytes:
    """Bytes of a model file on the driver (half a megabyte); tasks get them with their code."""
    with open(path, "rb") as f:
        return f.read()


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def _with(df: DataFrame, added: list[T.StructField]) -> tuple[list[str], T.StructType]:
    names = {f.name.lower() for f in added}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    return [f.name for f in kept], T.StructType(kept + added)


def encode(df: DataFrame, model: bytes, text: str = "text", decoded: bool = False) -> DataFrame:
    """All columns, and per piece ``ids``, ``begins`` and ``ends`` (bytes of the original text).

    With ``decoded`` the text of the ids is added in the same pass.
    """
    numbers = T.ArrayType(T.IntegerType(), False)
    added = [T.StructField(n, numbers) for n in ("ids", "begins", "ends")]
    kept, schema = _with(df, added + ([T.StructField("decoded", T.StringType())] if decoded else []))

    def run(batches):
        pieces = _pieces(model)
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
            for a, b in slices(lengths, SLICE_BYTES):
                part = batch.slice(a, b - a)
                offsets, ids, begins, ends = pieces.encode([t or "" for t in part.column(text).to_pylist()])
                columns = [part.column(c) for c in kept] + [_lists(offsets, x) for x in (ids, begins, ends)]
                if decoded:
                    columns.append(pa.array([pieces.decode(ids[x:y].tolist()) for x, y in zip(offsets, offsets[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model: bytes, ids: str = "ids") -> DataFrame:
    """All columns and the text of the ids as ``decoded``; null ids give null."""
    kept, schema = _with(df, [T.StructField("decoded", T.StringType())])

    def run(batches):
        pieces = _pieces(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [None if x is None else pieces.decode(x) for x in (v.as_py() for v in part.column(ids))]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, "decoded"])

    return df.mapInArrow(run, schema)
