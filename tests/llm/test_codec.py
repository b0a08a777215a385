"""The codec against the library: ids, round trips and byte spans."""

import hashlib
import random

import numpy as np
import pytest

from glyphgrid.llm.queries import tokenizer
from glyphgrid.llm.sentencepiece_codec import CharacterMap, Codec, decode, digests, encode, model_bytes

TEXTS = ["", " ", "Hello world", "  two  spaces ", "naïve café – 東京 🎉", "\n\ttabs\r\n", "▁under▁score", "a\u0000b", "ﬁ ligature ①", "x" * 5000, "é" * 300 + " "]


@pytest.fixture(scope="module")
def model():
    return model_bytes(tokenizer())


def test_digests_equal_the_library(spark, model):
    rows = [(k, t, "clash") for k, t in enumerate(TEXTS)] + [(99, None, None), (0, TEXTS[0], None), (None, "no id", None)]
    got = digests(spark.createDataFrame(rows, "doc_id long, text string, ids string"), model).collect()
    sp = Codec(model).model
    want = sorted((k, len(i := sp.encode(t or "", add_eos=True)), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(sp.decode(i).encode()).hexdigest()) for k, t, _ in rows if k is not None)
    assert sorted(tuple(r)[:4] for r in got if r.doc_id is not None) == want
    assert sum(r.doc_id is None for r in got) == 1


def test_spans_are_those_of_the_library(model):
    c = Codec(model)
    for t in TEXTS:
        ids = c.encode(t, True)
        begin, end = c.spans(t, ids)
        data = t.encode()
        proto = c.model.encode(t, return_type="proto")
        if t == t.rstrip():  # the library's last spans stop before white space at the end
            own = list(zip(begin.tolist(), end.tolist(), [p.piece for p in proto.pieces]))
            # of a character in bytes, the library gives all to the last byte's piece
            assert [x for x in own if x[2][:3] != "<0x"] == [(p.begin, p.end, p.piece) for p in proto.pieces if p.piece[:3] != "<0x"]
        # pieces tile the text: each begins where the one before ended
        assert (begin[1:] == end[:-1]).all() and (not len(data) or (begin[0], end[-1]) == (0, len(data)))


def test_character_map_takes_the_longest_prefix():
    import sentencepiece

    n = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(n.serialized_model_proto())
    m = CharacterMap(proto.normalizer_spec.precompiled_charsmap)
    assert m.units
    rng = random.Random(2)
    texts = ["ﬁ①ｶﾞ é é", "Å", *("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x250), rng.randrange(0xFF00, 0xFFEF), 0x301])) for _ in range(30)) for _ in range(100))]
    for t in texts:
        out, source = m.apply(t.encode())
        assert out.decode() == n.normalize(t)
        assert len(source) == len(out) + 1 and (np.diff(source) >= 0).all() and source[-1] == len(t.encode())


def test_encode_and_decode_columns(spark, model):
    df = spark.createDataFrame([(1, "Hello world", 5), (2, None, 6)], "id int, text string, begins int")
    out = decode(encode(df, "text", model), "ids", model).orderBy("id").collect()
    assert out[0].decoded == "Hello world" and out[0].begins[0] == 0 and out[0].ends[-1] == 11
    assert out[1].decoded == "" and out[1].n_tokens == 1


def test_empty_table(spark, model):
    assert digests(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
