"""Substring deduplication by relative Lempel-Ziv parsing.

Every document is both text to be parsed and reference. Its windows of ``SPAN``
words are cut into blocks by content: consecutive windows with the same anchor,
the least hash of ``ANCHOR`` words in the window, form a block, so that equal
windows of any two documents always lie in blocks with the same anchor. The
index holds each different block once, under the smallest document that has it.

A document is parsed greedily against it. A block that a smaller document holds
whole is a factor at once. Factors meet and end inside blocks whose anchor is
known elsewhere but whose words differ: these are checked at the factor's
boundary window by window. Windows found in a smaller document, joined, are the
factors of at least ``SPAN`` words, and the words they cover are duplicates.

Blocks and windows are compared by 128 bits, two hashes that have the halves of
their words' 128-bit hashes. Before blocks are shuffled for the index, equal ones of a
task are one row; texts are moved for boundary checks and for the result, never for
the index.

Defined results: a null text has no words; texts shorter than a window are kept
whole. Windows repeated inside a document do not count against it. Rows that
repeat an id are not smaller than each other; a row without an id is no
reference and is kept whole. Only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphgrid.session import discard, materialize

SPAN, ANCHOR = 50, 8
#: Words whose hashes a worker remembers.
REMEMBERED = 300_000
RUN = "anchor long, block long, check long, doc_id long, row long, start int, n int"
KEY = ("anchor", "block", "check")


class WordHashes(dict):
    """128-bit hashes of words, remembered as the places of their halves."""

    def __init__(self):
        import xxhash

        super().__init__()
        self.digest = xxhash.xxh3_128_digest
        self.fresh = bytearray()
        self.halves = np.empty((1 << 16, 2), np.uint64)

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        self.fresh += self.digest(word)
        return place

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The two halves of the hashes of the words of a text, in order."""
        words = text.split()
        if len(self) > REMEMBERED:
            self.clear()
        known = len(self)
        place = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            if len(self) > len(self.halves):
                self.halves = np.concatenate((self.halves[:known], np.empty((2 * len(self) - known, 2), np.uint64)))
            self.halves[known : len(self)] = np.frombuffer(bytes(self.fresh), "<u8").reshape(-1, 2)
            self.fresh.clear()
        return self.halves[place, 0], self.halves[place, 1]


def mixed(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """A hash of pairs that depends on their order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(salt))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(30))


def of_length(one: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Hashes of all runs of n, from the hashes of single words, by doubling."""
    width, now = 1, one
    while 2 * width <= n:
        now = mixed(now[:-width], now[width:], salt + width)
        width *= 2
    rest = n - width
    return mixed(now[:-rest], now[rest:], salt - 1) if rest else now


def least_of(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    width, now = 1, values
    while 2 * width <= n:
        now = np.minimum(now[:-width], now[width:])
        width *= 2
    rest = n - width
    return np.minimum(now[:-rest], now[rest:]) if rest else now


def blocks(one: np.ndarray, two: np.ndarray, span: int = SPAN, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(anchor, hash, second hash, first window, windows) of the blocks of a document, from the halves of its words' hashes."""
    least = least_of(of_length(one, anchor, 7), span - anchor + 1)
    first = np.concatenate(([0], np.nonzero(least[1:] != least[:-1])[0] + 1))
    n = np.diff(np.append(first, len(least)))
    place = (np.arange(len(least)) - np.repeat(first, n)).astype(np.uint64)
    both = [np.add.reduceat(mixed(of_length(half, span, 11), place, 5), first) + n.astype(np.uint64) for half in (one, two)]
    return least[first], *both, first, n


def keyed(docs: DataFrame) -> DataFrame:
    """Rows with words to parse; a row is known by its id and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return base.withColumn("row", F.xxhash64("doc_id", "text"))


def block_rows(rows: DataFrame, span: int, anchor: int) -> DataFrame:
    """The blocks of all documents, a batch of them at a time; rows without an id have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in range(7)]
            for doc, text, row in zip(*batch.columns, strict=True):
                if not doc.is_valid:
                    continue
                one, two = hashes.of(text.as_py().encode())
                if len(one) < span:
                    continue
                found = blocks(one, two, span, anchor)
                size = len(found[0])
                for part, x in zip(parts, (*found[:3], np.full(size, doc.as_py(), np.int64), np.full(size, row.as_py(), np.int64), *found[3:]), strict=True):
                    part.append(x)
            if parts[0]:
                a, b, c, doc, row, first, n = (np.concatenate(x) for x in parts)
                columns = [a.view(np.int64), b.view(np.int64), c.view(np.int64), doc, row, first.astype(np.int32), n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[x.split()[0] for x in RUN.split(", ")])

    return rows.select("doc_id", "text", "row").mapInArrow(run, RUN)


def windows_of(rows: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """(w1, w2, doc_id, row, start): the windows of the wanted blocks (row, starts), from the texts."""
    lists = wanted.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "n")).alias("at"))
    joined = rows.join(lists.hint("shuffle_hash"), ["doc_id", "row"]).select("doc_id", "text", "row", "at.start", "at.n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in range(5)]
            for doc, text, row, start, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one, two = hashes.of(text.encode())
                start, n = np.array(start, np.int64), np.array(n, np.int64)
                at = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                for part, x in zip(parts, (of_length(one, span, 11)[at], of_length(two, span, 11)[at], np.full(len(at), doc, np.int64), np.full(len(at), row, np.int64), at), strict=True):
                    part.append(x)
            if parts[0]:
                w1, w2, doc, row, at = (np.concatenate(x) for x in parts)
                yield pa.RecordBatch.from_arrays([pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(doc), pa.array(row), pa.array(at.astype(np.int32))], names=["w1", "w2", "doc_id", "row", "start"])

    return joined.mapInArrow(run, "w1 long, w2 long, doc_id long, row long, start int")


def factors(docs: DataFrame, span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """(row, doc_id, start, n): n windows from the start-th word that a smaller document holds.

    A block or window may be that of a third of all documents: blocks are summed
    up in each task first, and what is known of a key is written before it is
    joined, so that both sides of a join are plain shuffles that can be split.
    """
    rows = keyed(docs)
    every = materialize(block_rows(rows, span, anchor), "blocks")  # so that texts are cut once
    # read several times below
    known = materialize(every.groupBy(*KEY).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")), "known-blocks")
    varied = materialize(known.groupBy("anchor").agg(F.count("*").alias("blocks"), F.min("least").alias("from"), F.max("last").alias("to")).filter("blocks > 1 AND from < to").select("anchor", F.lit(True).alias("varied")), "varied-anchors")
    index = known.join(varied, "anchor", "left").withColumn("varied", F.coalesce("varied", F.lit(False))).filter("varied OR least < last").select(*KEY, "least", "varied")
    parsed = materialize(every.join(index, [*KEY]).filter("least < doc_id OR varied"), "parsed-blocks")
    discard(every, known, varied)
    whole = parsed.filter("least < doc_id").select("row", "doc_id", "start", "n")
    windows = materialize(windows_of(rows, parsed.filter("least = doc_id").select("doc_id", "row", "start", "n").distinct(), span), "boundary-windows")
    shared = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).filter("least < last").drop("last")
    checked = windows.join(materialize(shared, "shared-windows"), ["w1", "w2"]).filter("least < doc_id").select("row", "doc_id", "start")
    return whole.union(joined_runs(checked))


def joined_runs(windows: DataFrame) -> DataFrame:
    """Single windows (row, doc_id, start) that follow each other as one row (row, doc_id, start, n)."""
    order = Window.partitionBy("doc_id", "row").orderBy("start")
    numbered = windows.withColumn("run", F.col("start") - F.row_number().over(order))
    return numbered.groupBy("doc_id", "row", "run").agg(F.min("start").alias("start"), F.count("*").cast("int").alias("n")).select("row", "doc_id", "start", "n")


def without_duplicates(docs: DataFrame, span: int = SPAN, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row (and ``kept_text``, the kept words joined by one space)."""
    rows = keyed(docs)
    lists = factors(docs, span, anchor).groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "n")).alias("at"))
    joined = rows.join(lists.hint("shuffle_hash"), ["doc_id", "row"], "left").select("doc_id", "text", F.col("at.start").alias("start"), F.col("at.n").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, start, n in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                words = text.encode().split()
                size = len(words)
                if start:
                    step = np.zeros(size + 1, np.int64)
                    np.add.at(step, np.array(start), 1)
                    np.add.at(step, np.minimum(np.array(start) + np.array(n) + (span - 1), size), -1)
                    covered = np.cumsum(step[:-1]) > 0
                    words = [words[k] for k in np.nonzero(~covered)[0].tolist()]
                kept = b" ".join(words)
                out.append((size, size - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            columns = list(zip(*out)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))][: 5 if with_text else 4], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 5 if with_text else 4])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else ""))
