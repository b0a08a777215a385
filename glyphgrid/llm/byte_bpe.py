"""Byte-level BPE encoding and decoding by backtracking over longest matches.

A text is cut by a pattern; every piece is encoded apart. Bytes are read as
Latin-1 characters, so that one Aho-Corasick automaton over the vocabulary gives
the longest token that starts at each byte of a piece. From there the encoding
goes forward by the longest token that may stand behind the one before, goes
back where none may, and marks such places as dead, so each place is left at most
once. Whether two tokens may stand side by side (whether merging the bytes of
both by rank would leave them as they are) is found by undoing their merges next
to the border, and remembered. Exactly one encoding passes everywhere, that of
merging by rank.

Defined results: a null text counts as empty; an empty text has no ids and
decodes to no bytes. Repeated rows and equal texts are each encoded. Other columns
of the input are never read, so names that clash do not matter. A text of any
length is handled whole, and a long piece (a run of one letter) takes time in
proportion to its length.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Entries after which the memory of pieces, or of pairs, is emptied; pieces of more than KEPT_BYTES characters are not remembered.
REMEMBERED = 1 << 18
KEPT_BYTES = 64
#: Pieces that are worked on at a time.
PIECES = 1 << 16


class Pieces(dict):
    """The ids of a piece as little-endian 32-bit integers; short pieces are remembered."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        packed = np.frombuffer(self.codec.piece(piece.encode()), np.uint32).astype("<u4").tobytes()
        if len(piece) <= KEPT_BYTES:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = packed
        return packed


class Codec:
    """Encoding and decoding with one vocabulary; built once in each Python worker.

    ``ranks`` is the content of a rank file (base64 token, blank, rank). Every
    byte must be a token and come before all longer ones, and merging by the ranks
    below its own must leave two tokens of every longer one; else it is an error.
    """

    def __init__(self, ranks: bytes, pattern: str):
        import ahocorasick
        import regex

        by_rank = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, ranks.splitlines()) if token)
        self.rank_of = {token: rank for rank, token in by_rank}
        size = by_rank[-1][0] + 1 if by_rank else 0
        self.tokens = [b""] * size
        for rank, token in by_rank:
            self.tokens[rank] = token
        if [len(token) for _, token in by_rank[:256]] != [1] * 256:
            raise ValueError("the first 256 ranks must be the bytes")
        self.find = regex.compile(pattern)
        self.length = [len(token) for token in self.tokens]
        self.merged: dict[int, int] = {}
        self.left, self.right, self.shorter = [-1] * size, [-1] * size, [-1] * size
        self.size = size
        self._pairs: dict[int, bool] = {}  # of the whole vocabulary, so filled once all merges are known
        self.pieces = Pieces(self)
        self.automaton = ahocorasick.Automaton()
        for rank, token in by_rank:
            self._split(rank, token)
            self.automaton.add_word(token.decode("latin-1"), rank)
        for rank, token in by_rank:
            self.shorter[rank] = next((self.rank_of[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.rank_of), -1)
        self.automaton.make_automaton()

    def _split(self, rank: int, token: bytes) -> None:
        """Find the last merge that makes ``token``, from tokens of lower ranks that may stand side by side."""
        for n in range(len(token) - 1, 0, -1):
            a, b = self.rank_of.get(token[:n], rank), self.rank_of.get(token[n:], rank)
            if a < rank and b < rank and self._unmerged(a, b):
                self.left[rank], self.right[rank] = a, b
                self.merged[a * self.size + b] = rank
                return
        if len(token) > 1:
            raise ValueError(f"no merge of lower ranks makes token {rank}")

    def beside(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves ``a`` and ``b`` as they are where one follows the other."""
        key = a * self.size + b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= REMEMBERED:
                self._pairs.clear()
            known = self._pairs[key] = self._unmerged(a, b)
        return known

    def _unmerged(self, a: int, b: int) -> bool:
        """Undo the merges next to the border, the latest first: none across it may have come before them."""
        before = self.size + 1
        while True:
            if self.merged.get(a * self.size + b, before) < before:
                return False
            # of equal ranks the left one is merged first: across the border before b's own, after a's own
            if a > b and self.left[a] >= 0:
                before, a = a, self.right[a]
            elif self.left[b] >= 0:
                before, b = b + 1, self.left[b]
            elif self.left[a] >= 0:
                before, a = a, self.right[a]
            else:
                return True

    def piece(self, data: bytes) -> array:
        """The ids of one piece."""
        whole = self.rank_of.get(data)
        if whole is not None:
            return array("I", (whole,))
        length, shorter, beside, n = self.length, self.shorter, self.beside, len(data)
        longest = array("i", bytes(4 * n))
        for end, rank in self.automaton.iter(data.decode("latin-1")):  # later ends are longer tokens
            longest[end - length[rank] + 1] = rank
        alive, ids, at, t = bytearray(b"\1") * (n + 1), array("I"), 0, longest[0]
        while at < n:
            while t >= 0 and not (alive[at + length[t]] and (not ids or beside(ids[-1], t))):
                t = shorter[t]
            if t >= 0:
                ids.append(t)
                at += length[t]
                t = longest[at] if at < n else -1
            else:
                alive[at] = 0
                t = ids.pop()
                at -= length[t]
                t = shorter[t]
        return ids

    def encoded(self, text: str) -> Iterator[bytes]:
        """The packed ids of a text, some pieces at a time."""
        if len(text) <= PIECES:
            yield b"".join(map(self.pieces.__getitem__, self.find.findall(text)))
            return
        pieces = (m.group() for m in self.find.finditer(text))
        while some := list(islice(pieces, PIECES)):
            yield b"".join(map(self.pieces.__getitem__, some))

    def decoded(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=4)
def codec(ranks: bytes, pattern: str) -> Codec:
    return Codec(ranks, pattern)


def rank_bytes(path: str) -> bytes:
    """The ranks travel with the tasks (under a MB), so that only the driver needs their file."""
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, text: str | Column, ranks: bytes, pattern: str, to: str = "ids") -> DataFrame:
    """``df`` with the ids of the text in a column ``to``, which replaces one of that name."""

    @F.pandas_udf("array<long>")
    def ids(texts):
        import pandas as pd

        c = codec(ranks, pattern)
        return pd.Series([np.frombuffer(b"".join(c.encoded(t)), "<u4").astype("int64") for t in texts.fillna("")], dtype=object)

    return df.withColumn(to, ids(F.col(text) if isinstance(text, str) else text))


def decode(df: DataFrame, ids: str, ranks: bytes, pattern: str, to: str = "decoded") -> DataFrame:
    """``df`` with the bytes of the ids (a text may be cut inside a character); null ids give no bytes."""

    @F.pandas_udf("binary")
    def decoded(lists):
        import pandas as pd

        c = codec(ranks, pattern)
        return pd.Series([c.decoded(np.array(x, "<u4").tobytes()) if x is not None else b"" for x in lists], dtype=object)

    return df.withColumn(to, decoded(F.col(ids)))


def digests(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """One row a document: number of ids, digests of the ids and of the decoded bytes.

    Reads ``doc_id`` and ``text`` only. Ids stay in the Python worker, some
    pieces at a time, so that only digests leave it. A null id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column(1):
                said, back, n = hashlib.sha256(), hashlib.sha256(), 0
                for packed in c.encoded(text.as_py() or ""):
                    said.update(packed)
                    back.update(c.decoded(packed))
                    n += len(packed) // 4
                rows.append((n, said.hexdigest(), back.hexdigest()))
            columns = list(zip(*rows)) or [[]] * 3
            kinds = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, DIGEST)
