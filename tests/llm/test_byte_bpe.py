"""Byte-level BPE against the library: ids, round trips, odd vocabularies."""

import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken
from public_tokenizers import PATTERN

from glyphgrid.llm.byte_bpe import Codec, codec, decode, digests, encode, rank_bytes
from glyphgrid.llm.queries import RANKS, tokenizer

TEXTS = ["", " ", "Hello world", "  two  spaces \n\n x", "naïve café – 東京 🎉", "a\u0000b\x1c\x85", "<|endoftext|>", "don't I'LL 123456 ١٢٣", "x" * 70000, "ab" * 5000, "=" * 300 + "é", "é" * 200]


@pytest.fixture(scope="module")
def ranks():
    return rank_bytes(tokenizer(RANKS))


def library(ranks):
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def ids(c, text):
    return np.frombuffer(b"".join(c.encoded(text)), "<u4").tolist()


def test_ids_are_those_of_the_library(ranks):
    c, own, rng = codec(ranks, PATTERN), library(ranks), random.Random(5)
    tokens = [t.decode("utf8", "ignore").replace(" ", "") for t in c.tokens]
    texts = TEXTS + ["".join(rng.choice(tokens) for _ in range(rng.randint(1, 6))) for _ in range(3000)]
    texts += ["".join(rng.choice("etaoins ") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x2FF), rng.randrange(0x4E00, 0x9FFF), rng.randrange(0x1F300, 0x1F6FF)])) for _ in range(20)) for _ in range(1000)]
    for t in texts:
        assert ids(c, t) == own.encode_ordinary(t)
        assert c.decoded(b"".join(c.encoded(t))) == t.encode()


def merged(table, data):
    """Merging by rank, one pair at a time."""
    if data in table:
        return [table[data]]
    parts = [data[k : k + 1] for k in range(len(data))]
    while True:
        best = min(((table[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in table), default=None)
        if best is None:
            return [table[p] for p in parts]
        k = best[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_random_vocabularies_equal_merging_by_rank():
    rng = random.Random(11)
    for _ in range(60):
        order = list(range(256))
        rng.shuffle(order)
        table = {bytes([b]): k for k, b in enumerate(order)}
        letters = [b"a", b"b", b"c"]
        made = letters[:]
        while len(table) < 280:
            t = rng.choice(made) + rng.choice(made)
            if len(t) < 9 and t not in table and len(merged(table, t)) == 2:
                table[t] = len(table)
                made.append(t)
        c = Codec(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in table.items()), r"[\s\S]+")
        for _ in range(100):
            data = b"".join(rng.choice(letters) for _ in range(rng.randint(1, 25)))
            assert ids(c, data.decode()) == merged(table, data)


def test_digests_of_odd_rows(spark, ranks):
    rows = [(k, t, "clash") for k, t in enumerate(TEXTS)] + [(99, None, None), (0, TEXTS[0], None), (None, "no id", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string")
    own = library(ranks)
    want = sorted((k if k is not None else -1, len(i := own.encode_ordinary(t or "")), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for k, t, _ in rows)
    got = digests(frame, ranks, PATTERN).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got) == want
    assert digests(frame.limit(0), ranks, PATTERN).count() == 0


def test_columns(spark, ranks):
    df = spark.createDataFrame([(1, "Hello 東京"), (2, None)], "ids int, text string")
    out = decode(encode(df, "text", ranks, PATTERN), "ids", ranks, PATTERN).collect()
    assert bytes(out[0].decoded).decode() == "Hello 東京" and out[0].ids == library(ranks).encode_ordinary("Hello 東京")
    assert bytes(out[1].decoded) == b"" and out[1].ids == []


def test_a_vocabulary_without_all_bytes_is_an_error():
    with pytest.raises(ValueError):
        Codec(b"YQ== 0", ".")
    every = [base64.b64encode(bytes([k])) + b" %d" % k for k in range(256)]
    with pytest.raises(ValueError):  # no merge leads to a token of three
        Codec(b"\n".join([*every, base64.b64encode(b"abc") + b" 256"]), ".")
