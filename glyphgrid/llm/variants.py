"""Spelling variants: words one edit apart, grouped under the most frequent form.

Words are counted over all documents with partial sums. The vocabulary is sorted
in ranges, and every range written as compact tries (shards) of bounded size, one
behind the other. Shards are broadcast some megabytes at a time; each word's
automaton for one edit is run through them depth-first. Along the word's own path
the automaton has spent nothing; where the trie branches off it spends its edit, and
from there exactly one continuation of the word is left to follow. So a neighbour is
found once, at the first letter that differs. What a word found in a shard is one
row (how many, and the best of them), and these rows are reduced by word.

Defined results: null texts have no words; a null id is written as the empty string.
Repeated rows count again. Words of equal counts: the smaller in code-point order is
the form. A word of any length is a word (a shard ends at ``SHARD_BYTES``, or holds one
longer word). Only ``doc_id`` and ``text`` are read, so names that clash do not
matter. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphgrid.session import discard, materialize, tasks

LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form has at least so many times the count of the word.
TIMES = 5
#: One occurrence in so many loses a letter.
MISSPELT_EVERY = 199
#: Bytes of the words of a shard, and of the shards broadcast together.
SHARD_BYTES = 1 << 19
WAVE_BYTES = 8 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOUND = "word string, n_near long, best_n long, best string"


def occurrences(docs: DataFrame) -> DataFrame:
    """(word, n) of every word of ``LEAST_LENGTH`` letters; one run in ``MISSPELT_EVERY`` is taken without one of its letters."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"[a-z\\u00C0-\\u00FF]{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    dealt = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run")))
    cut = (F.col("h") % F.length("run")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), cut), F.substring("run", cut + 2, F.length("run")))
    words = dealt.select(F.when(F.col("h") % MISSPELT_EVERY == 0, without).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def vocabulary(docs: DataFrame) -> DataFrame:
    return occurrences(docs).filter((F.col("n") >= LEAST_COUNT) & (F.length("word") >= LEAST_LENGTH))


class Trie:
    """A trie of sorted words with one node for every branch or end of a word.

    Node 0 is the root. A node's edge is ``letters[begin[k]:begin[k + 1]]``; its children
    are the nodes ``child[k]`` up to ``child[k + 1]``, in order; ``word[k]`` is the number of
    the word that ends there, or -1.
    """

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.counts = words, counts
        # depth first: a range of words that share ``depth`` letters is a node
        edges, sizes, ends, spans = [""], [], [], [(0, len(words), 0)]
        for first, last, depth in spans:  # grows while it is read, so nodes come level by level
            end = first if first < last and len(words[first]) == depth else -1
            ends.append(end)
            first, before = first + (end >= 0), len(spans)
            while first < last:
                letter, stop = words[first][depth], first + 1
                while stop < last and words[stop][depth] == letter:
                    stop += 1
                shared = depth + 1 + common(words[first], words[stop - 1], depth + 1)
                edges.append(words[first][depth:shared])
                spans.append((first, stop, shared))
                first = stop
            sizes.append(len(spans) - before)
        self.letters = "".join(edges)
        self.begin = [0, *accumulate(map(len, edges))]
        self.child = [1, *(1 + k for k in accumulate(sizes))]
        self.word = ends
        self._index()

    def _index(self) -> None:
        self.at = {(node, self.letters[self.begin[k]]): k for node in range(len(self.word)) for k in range(self.child[node], self.child[node + 1])}

    def packed(self) -> bytes:
        number = [np.array(x, "<i4").tobytes() for x in (self.begin, self.child, self.word)]
        return pickle.dumps((self.words, np.array(self.counts, "<i8").tobytes(), self.letters, *number), protocol=5)

    @classmethod
    def unpacked(cls, data: bytes) -> Trie:
        trie = cls.__new__(cls)
        trie.words, counts, trie.letters, begin, child, word = pickle.loads(data)
        trie.counts = np.frombuffer(counts, "<i8").tolist()
        trie.begin, trie.child, trie.word = (np.frombuffer(x, "<i4").tolist() for x in (begin, child, word))
        trie._index()
        return trie

    def exactly(self, w: str, i: int, node: int, skip: int) -> int:
        """The word that the path ``w[i:]`` leads to from ``skip`` letters into the edge of ``node``; -1 if there is none."""
        while True:
            begin, end = self.begin[node] + skip, self.begin[node + 1]
            n = end - begin
            if n and (len(w) - i < n or not w.startswith(self.letters[begin:end], i)):
                return -1
            i += n
            if i == len(w):
                return self.word[node]
            node, skip = self.at.get((node, w[i]), -1), 0
            if node < 0:
                return -1

    def neighbours(self, w: str) -> Iterator[int]:
        """The words exactly one edit from ``w``, each once: the edit is at the first letter that differs."""
        node, i = 0, 0
        while True:
            # inside the edge of the node: the first letter that differs, if any
            begin, end = self.begin[node], self.begin[node + 1]
            same = common(w, self.letters[begin:end], i, 0)
            if begin + same < end:
                tries = [(i + same + 1, same + 1), (i + same, same + 1), (i + same + 1, same)]  # replaced, inserted, deleted
                for j, skip in tries if i + same < len(w) else tries[1:2]:
                    if (found := self.exactly(w, j, node, skip)) >= 0:
                        yield found
                return
            i += same
            own = w[i] if i < len(w) else ""
            if i == len(w) - 1 and self.word[node] >= 0:  # the last letter deleted
                yield self.word[node]
            for k in range(self.child[node], self.child[node + 1]):
                if self.letters[self.begin[k]] != own:
                    if own and (found := self.exactly(w, i + 1, k, 1)) >= 0:
                        yield found
                    if (found := self.exactly(w, i, k, 1)) >= 0:
                        yield found
            if i + 1 < len(w) and w[i + 1] != own and (k := self.at.get((node, w[i + 1]), -1)) >= 0 and (found := self.exactly(w, i + 1, k, 0)) >= 0:
                yield found
            node = self.at.get((node, own), -1)
            if node < 0:
                return


def common(a: str, b: str, i: int, j: int | None = None) -> int:
    """How many letters ``a[i:]`` and ``b[j:]`` have in common at their start."""
    j = i if j is None else j
    most = min(len(a) - i, len(b) - j)
    n = 0
    while n < most and a[i + n] == b[j + n]:
        n += 1
        if n & 255 == 0:  # long words: by doubling steps
            step = 256
            while n + step <= most and a[i + n : i + n + step] == b[j + n : j + n + step]:
                n += step
                step *= 2
    return n


def shards(words: DataFrame) -> DataFrame:
    """(shard, bytes, trie): the vocabulary in sorted ranges, cut into tries of at most ``SHARD_BYTES`` of words."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            data = Trie(some, counts).packed()
            return pa.RecordBatch.from_arrays([pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())], names=["bytes", "trie"])

        some: list[str] = []
        counts: list[int] = []
        held = 0
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if some and held + 4 * len(word) > SHARD_BYTES:
                    yield done()
                    some, counts, held = [], [], 0
                some.append(word)
                counts.append(n)
                held += 4 * len(word)
        if some:
            yield done()

    ranged = words.select("word", "n").repartitionByRange(tasks(words.sparkSession), "word").sortWithinPartitions("word")
    return ranged.mapInArrow(build, "bytes long, trie binary").withColumn("shard", F.monotonically_increasing_id())


def searched(tries: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task over words, for the broadcast shards ``tries``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = [Trie.unpacked(data) for data in tries.value]
        for batch in batches:
            rows = []
            for word in batch.column(0).to_pylist():
                for trie in loaded:
                    near, best = 0, None
                    for k in trie.neighbours(word):
                        near += 1
                        said = (-trie.counts[k], trie.words[k])
                        best = said if best is None or said < best else best
                    if best is not None:
                        rows.append((word, near, -best[0], best[1]))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "best_n", "best"])

    return run


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of every word that has a neighbour, written to the shared folder."""
    spark = words.sparkSession
    stored = materialize(shards(words), "tries")
    waves: list[list[int]] = []
    room = 0
    for said in stored.select("shard", "bytes").orderBy("shard").toLocalIterator():  # one row a shard, no words
        if said["bytes"] > room:
            waves.append([])
            room = max(WAVE_BYTES, said["bytes"])
        waves[-1].append(said["shard"])
        room -= said["bytes"]
    # tasks by rows, for words are few bytes and much work
    dealt = materialize(words.select("word").repartition(tasks(spark), "word"), "searching") if waves else words.select("word")
    found = []
    for wave in waves:
        within = F.col("shard").between(wave[0], wave[-1])  # shards of a wave follow each other
        tries = spark.sparkContext.broadcast([bytes(r["trie"]) for r in stored.filter(within).select("trie").collect()])
        found.append(materialize(dealt.mapInArrow(searched(tries), FOUND), "near"))
        tries.destroy()
    rows = spark.createDataFrame([], FOUND)
    for part in found:
        rows = part if part is found[0] else rows.unionByName(part)
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("best"))).alias("first")
    reduced = materialize(rows.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("first.minus")).alias("best_n"), "first.best"), "near")
    discard(stored, *found, *([dealt] if waves else []))
    return reduced


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of the words of ``forms`` (word, form): forms are followed to the last, twice as far each round.

    Counts rise by ``TIMES`` from a word to its form, so there is no circle.
    """
    now, left = materialize(forms.select("word", F.col("form").alias("root")), "roots"), -1
    while left != 0:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        last, now = now, materialize(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        left = now.filter("moved").count()
        now = now.drop("moved") if left == 0 else now
        if last is not None:
            discard(last)
    return now


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary."""
    words = materialize(vocabulary(docs), "vocabulary")
    near = near_words(words)
    joined = words.join(near, "word", "left")
    is_form = F.col("best_n") >= TIMES * F.col("n")
    said = materialize(joined.select("word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n")), "forms")
    discard(words, near)
    roots = rooted(said.filter("form IS NOT NULL"))
    return said.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
