"""SentencePiece encoding and decoding that keeps the byte offsets of every piece.

The text is normalised as the model prescribes: at each position the longest
prefix in the compiled character map is replaced, and for every normalised byte
the source byte it came from is recorded. The pieces of an encoding tile the
normalised bytes, so their running lengths, looked up in that record, give the
span of original bytes of each piece.

Defined results: a null text counts as empty; an empty text has only the end id
(when asked for), no spans and decodes to the empty string. Repeated rows and
equal texts are each encoded. Other columns of the input are never read, so
names that clash do not matter. A text of any length is handled whole, one
text at a time.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphgrid.session import small_batches

SPACE = "▁".encode()
ENCODED = "n_tokens long, ids array<int>, begins array<int>, ends array<int>"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long"


class CharacterMap:
    """The model's compiled character map: a double array of prefixes and their replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.strings = blob[4 + size :]
        self._known: dict[bytes, tuple[int, bytes]] = {}

    def longest_prefix(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes read, replacement) of the longest mapped prefix of ``data[at:]``."""
        units = self.units
        if not units:
            return None
        node, found = (units[0] >> 10) << ((units[0] & 0x200) >> 6), None
        for k in range(at, len(data)):
            byte = data[k]
            node ^= byte
            unit = units[node]
            if (unit & 0x800000FF) != byte:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                value = units[node] & 0x7FFFFFFF
                end = self.strings.index(b"\0", value)
                found = (k + 1 - at, self.strings[value:end])
        return found

    def apply(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each the source offset; one more offset for the end."""
        if not self.units:
            return data, np.arange(len(data) + 1, dtype=np.int64)
        out, source, at = bytearray(), [], 0
        while at < len(data):
            hit = self.longest_prefix(data, at)
            if hit is None:  # one character stands for itself
                width = 1
                while at + width < len(data) and data[at + width] & 0xC0 == 0x80:
                    width += 1
                out += data[at : at + width]
                source.extend(range(at, at + width))
                at += width
            else:
                out += hit[1]
                source.extend([at] * len(hit[1]))
                at += hit[0]
        return bytes(out), np.array([*source, len(data)], np.int64)


class Codec:
    """Encoding, spans and decoding with one model; built once in each Python worker."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.spec = proto.normalizer_spec
        self.map = CharacterMap(self.spec.precompiled_charsmap)
        kinds = {"control": 3, "byte": 6, "unknown": 2}
        self.width = np.array([0 if p.type == kinds["control"] else 1 if p.type == kinds["byte"] else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.unknown = np.array([p.type == kinds["unknown"] for p in proto.pieces])
        self.decimal = [str(i) for i in range(len(proto.pieces))]

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """What the model segments, with the source offset of each byte (and of the end)."""
        body, source = self.map.apply(data)
        spec = self.spec
        if spec.remove_extra_whitespaces:
            byte = np.frombuffer(body, np.uint8) == 0x20
            keep = ~byte | ~np.concatenate(([True], byte[:-1]))
            last = len(byte)
            while last and byte[last - 1]:
                last -= 1
            keep[last:] = False
            body = np.frombuffer(body, np.uint8)[keep].tobytes()
            source = np.append(source[:-1][keep], source[last] if len(byte) else source[-1])
        if not body:
            return b"", np.zeros(1, np.int64)
        if spec.add_dummy_prefix:
            body, source = b" " + body, np.concatenate((source[:1], source))
        if spec.escape_whitespaces and b" " in body:
            repeat = np.where(np.frombuffer(body, np.uint8) == 0x20, len(SPACE), 1)
            body, source = body.replace(b" ", SPACE), np.append(np.repeat(source[:-1], repeat), source[-1])
        return body, source

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Original byte spans [begin, end) of the pieces ``ids``."""
        body, source = self.normalise(text.encode())
        width = self.width[ids]
        if self.unknown[ids].any():  # an unknown piece has the length of what it stands for
            pieces = self.model.encode(text, out_type=str)
            width = np.array([len(p.encode()) for p in pieces] + [0] * (len(ids) - len(pieces)), np.int64)
        stop = np.cumsum(width)
        if len(ids) and stop[-1] != len(body):
            raise ValueError(f"pieces cover {stop[-1]} of {len(body)} normalised bytes")
        return source[stop - width], source[stop]

    def encode(self, text: str, end: bool) -> np.ndarray:
        return np.array(self.model.encode(text, add_bos=False, add_eos=end), np.int64)


@lru_cache(maxsize=4)
def codec(model: bytes) -> Codec:
    return Codec(model)


def model_bytes(path: str) -> bytes:
    """The model travels with the tasks (half a MB), so that only the driver needs its file."""
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, text: str | Column, model: bytes, end: bool = True) -> DataFrame:
    """``df`` with ids and the original byte spans of the pieces (columns of ``ENCODED``).

    Columns of ``df`` with one of these names are replaced.
    """
    small_batches(df.sparkSession)

    @F.pandas_udf(ENCODED)
    def encoded(texts):
        import pandas as pd

        c, rows = codec(model), []
        for t in texts.fillna(""):
            ids = c.encode(t, end)
            begins, ends = c.spans(t, ids)
            rows.append((len(ids), ids, begins, ends))
        return pd.DataFrame(rows, columns=["n_tokens", "ids", "begins", "ends"])

    names = ["n_tokens", "ids", "begins", "ends"]
    column = F.col(text) if isinstance(text, str) else text
    return df.withColumn("__sp", encoded(column)).withColumns({n: F.col(f"__sp.{n}") for n in names}).drop("__sp")


def decode(df: DataFrame, ids: str, model: bytes, to: str = "decoded") -> DataFrame:
    """``df`` with the text of the ids; null ids decode to the empty string."""
    small_batches(df.sparkSession)

    @F.pandas_udf("string")
    def decoded(lists):
        import pandas as pd

        c = codec(model)
        return pd.Series([c.model.decode([int(i) for i in x]) if x is not None else "" for x in lists], dtype=object)

    return df.withColumn(to, decoded(F.col(ids)))


def digests(docs: DataFrame, model: bytes, end: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: number of ids, digests of the ids and of the decoded text, bytes under spans.

    Reads ``doc_id`` and ``text`` of ``docs`` only, and passes on the columns
    ``keep``, last. Ids and texts stay in the Python worker, so that only
    digests leave it. A null id stays null.
    """
    small_batches(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        decimal = c.decimal.__getitem__
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            rows: list[tuple] = []
            for k in range(len(texts)):
                t = texts[k].as_py() or ""
                ids = c.model.encode(t, add_bos=False, add_eos=end)
                begins, ends = c.spans(t, np.array(ids, np.int64))
                said = hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest()
                back = hashlib.sha256(c.model.decode(ids).encode()).hexdigest()
                rows.append((len(ids), said, back, int((ends - begins).sum())))
            columns = list(zip(*rows)) or [[]] * 4
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True)), *batch.columns[2:]], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "span_bytes", *keep])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    return rows.mapInArrow(run, ", ".join([DIGEST, *(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])]))
