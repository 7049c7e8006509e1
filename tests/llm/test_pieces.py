import random

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from tidemark.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "   a", "a  ", "\n", " \n x", "▁", "▁▁ a▁b", "é́x", "ﬁne ①Ｈ", "\0a\0", "a\tb\r\n", "<s> </s> <0x0A>",
    "日本語 テキスト", "𝔘𝔫𝔦 😀😀", "​﻿ 　x", "a" * 500, "word " * 300, "½ ㍿ ｶﾞ",
]


def samples():
    rng = random.Random(5)
    alphabet = "abc  \n\t▁é́ﬁ①Ｈ日😀ñ.０½ｶﾞ㍿ ​'"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(400)]


def model_with(rule, trim):
    model = pb.ModelProto.FromString(pieces.read_model(PATH))
    model.normalizer_spec.remove_extra_whitespaces = trim
    if rule:
        spec = pb.NormalizerSpec.FromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
        model.normalizer_spec.precompiled_charsmap = spec.precompiled_charsmap
    return model.SerializeToString()


@pytest.mark.parametrize("rule,trim", [(None, False), (None, True), ("nfkc", False), ("nmt_nfkc", True), ("nmt_nfkc_cf", True)])
def test_ids_spans_and_text_equal_the_library(rule, trim):
    blob = model_with(rule, trim)
    library = sentencepiece.SentencePieceProcessor(model_proto=blob)
    own = pieces.Pieces(blob)
    texts = samples()
    offsets, ids, begins, ends = own.encode(texts)
    for i, text in enumerate(texts):
        a, b = offsets[i], offsets[i + 1]
        want = library.encode(text, add_bos=True, add_eos=True)
        assert ids[a:b].tolist() == want, repr(text)
        assert own.decode(want) == library.decode(want), repr(text)
        size = len(text.encode())
        assert all(0 <= x <= y <= size for x, y in zip(begins[a:b], ends[a:b]))
        assert (begins[a:b][1:] >= begins[a:b][:-1]).all()
        if rule is None and not trim:  # copied bytes: the spans tile the text
            assert b"".join(text.encode()[x:y] for x, y in zip(begins[a:b], ends[a:b])) == text.encode()


def test_decode_of_any_ids():
    own = pieces.Pieces(pieces.read_model(PATH))
    rng = random.Random(1)
    for _ in range(200):
        ids = [rng.randrange(3 if rng.random() < 0.9 else 0, 32000 if rng.random() < 0.5 else 300) for _ in range(rng.randrange(12))]
        assert own.decode(ids) == own.library.decode(ids), ids


def test_frames(spark):
    blob = pieces.read_model(PATH)
    rows = [(1, "Hello  wörld", "x"), (2, None, "y"), (2, None, "y"), (3, "", None), (4, "a b " * 60_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = pieces.decode(pieces.encode(df, blob), blob).orderBy("doc_id").collect()
    assert [r.decoded for r in out] == ["Hello  wörld", "", "", "", "a b " * 60_000]
    assert out[1].ids == [1, 2] and out[0].begins[0] == 0 and out[0].ends[-1] == len("Hello  wörld".encode())
    again = pieces.encode(df, blob, decoded=True).orderBy("doc_id").collect()
    assert [(r.ids, r.decoded) for r in again] == [(r.ids, r.decoded) for r in out]
    assert pieces.encode(df.limit(0), blob).count() == 0
