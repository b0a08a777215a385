"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds a bounded sample of labelled text. A
text is parsed greedily against it: a phrase grows as long as it occurs in the
sample, then the next begins. A text in the sample's language needs few, long
phrases; phrases times the logarithm of the sample's length estimate the cross
entropy, and the language with the least wins (ties: the smaller name). A letter
that the sample lacks is a phrase of its own and costs ``LITERAL`` bits more, as
it has to be spelled out.

The whole text is parsed, in rows of ``ROW`` characters that all advance by one
character at a time, so that a batch of texts of any lengths is a few array
operations a character. A row begins in the state in which the row before it
ended: rows whose state was not known yet are parsed again. Parses from different
states soon meet, so that is twice in most cases; rows that have not met after
``PASSES`` (a run of one letter) are gone through one character after the other,
so that the time is in proportion to the text, whatever it repeats.

Memory of a worker: the tables of all languages take at most ``TABLE_BYTES``, with
a share for each; a language whose letters need more has its transitions in a sorted
list. A text of a 65th label, by number of rows, is given one of the 64 learned.

Defined results: a null text, and one without a letter, is ``und`` with score 0,
and so is every text if nothing was learned. Rows are judged one by one;
columns other than id, text and label are never read, and the label only where
it trains.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphgrid.session import slices, small_batches

#: The sample: languages learned (those with most rows), rows looked at and characters held for each.
LANGUAGES, SAMPLE_ROWS, SAMPLE_CHARS = 64, 48, 20_000
ROW = 256
#: Bytes of all languages' tables, and passes over rows side by side.
TABLE_BYTES = 256 << 20
PASSES = 3
#: Bits that name any code point.
LITERAL = 20
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that never train: checksum of the id, as text, leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, languages: int = LANGUAGES) -> dict[str, str]:
    """Labelled text for each language: the first rows by a hash of the id, joined, up to ``chars`` characters.

    Only labels, ids and texts of training rows are looked at; the best rows of
    each task are picked before they are shuffled, so a frequent language is no
    burden to one task.
    """
    usable = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "doc_id", "text", F.xxhash64("doc_id").alias("order"))
    known = [r["lang"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()]
    first = Window.partitionBy("lang").orderBy("order", "doc_id", "text")
    picked = usable.filter(F.col("lang").isin(known)).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= rows).select("lang", "n", F.substring("text", 1, chars).alias("text"))
    texts: dict[str, str] = {}
    for r in sorted(picked.collect(), key=lambda r: (r["lang"], r["n"])):
        texts[r["lang"]] = (texts.get(r["lang"], "") + " " + r["text"])[:chars]
    return texts


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point: is it a letter."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class SuffixAutomaton:
    """All substrings of a sequence of symbols, as transitions from state 0."""

    def __init__(self, sequence: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in sequence:
            new = len(length)
            self.next.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(length)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new

    def transitions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(state, symbol, next state) of all transitions."""
        flat = [(state, c, to) for state, row in enumerate(self.next) for c, to in row.items()]
        return tuple(np.array(x, np.int64) for x in zip(*flat, strict=True)) if flat else (np.zeros(0, np.int64),) * 3


class Greedy:
    """The greedy parse of one language: its letters, and from state and symbol twice the next state, plus 1 where a phrase begins."""

    def __init__(self, text: str, symbol: np.ndarray, letters_: int, room: int = TABLE_BYTES):
        # symbols of the language: its letters, then one for blanks, for letters it has not, and for what fills a row
        own = np.unique(text_symbols(text, symbol))
        own = own[own < letters_]
        self.blank, self.other, self.pad, self.width = len(own), len(own) + 1, len(own) + 2, len(own) + 3
        self.local = np.full(letters_ + 3, self.other, np.int32)
        self.local[own] = np.arange(len(own))
        self.local[letters_], self.local[letters_ + 2] = self.blank, self.pad
        sequence = self.local[text_symbols(text, symbol)]
        automaton = SuffixAutomaton(sequence.tolist())
        state, c, to = automaton.transitions()
        self.bits = math.log2(max(len(sequence), 2))
        root = np.full(self.width, 1, np.int64)  # from the root; what the sample has not is a phrase of its own
        root[c[state == 0]] = 2 * to[state == 0] + 1
        self.table, self.keys = None, None
        if 4 * len(automaton.next) * self.width <= room:
            self.table = np.tile(root, (len(automaton.next), 1))
            self.table[state, c] = 2 * to + (state == 0)
            self.table[:, self.pad] = 0
            self.table = self.table.ravel().astype(np.int32)
        else:
            order = np.argsort(state * self.width + c)
            self.keys, self.to, self.root = (state * self.width + c)[order], (2 * to + (state == 0))[order], root
            self.root[self.pad] = 0

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[state * self.width + c]
        key = state.astype(np.int64) * self.width + c
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], self.root[c]).astype(np.int32)

    def phrases(self, columns: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Phrases that begin in each row of symbols (given by columns); ``first``: does a row begin its text."""
        n, own = columns.shape[1], self.local[columns]
        begin, end, count = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        wanted = np.arange(n)
        for _ in range(PASSES):
            if not len(wanted):
                break
            state, some = begin[wanted], np.zeros(len(wanted), np.int32)
            for column in own[:, wanted] if len(wanted) < n else own:
                state = self.step(state, column)
                some += state & 1
                state = state >> 1
            end[wanted], count[wanted] = state, some
            carried = np.where(first, 0, np.concatenate((end[:1], end[:-1]))).astype(np.int32)
            wanted = np.flatnonzero(carried != begin)
            begin = carried
        if len(wanted):
            self.one_by_one(own, first, begin, end, count, wanted)
        return count


    def one_by_one(self, own: np.ndarray, first: np.ndarray, begin: np.ndarray, end: np.ndarray, count: np.ndarray, wanted: np.ndarray) -> None:
        """Parse the rows that have not met, and those that then begin otherwise, in order; counts change in place."""
        if self.table is not None:
            table, width = memoryview(self.table), self.width
            step = lambda state, c: table[state * width + c]
        else:
            to, root, width = dict(zip(self.keys.tolist(), self.to.tolist(), strict=True)), self.root.tolist(), self.width
            step = lambda state, c: to.get(state * width + c, root[c])
        row, due = -1, wanted.tolist()
        for start in due:
            row = max(row, start)
            while row < len(first) and (row == start or begin[row] != (0 if first[row] else end[row - 1])):
                state = begin[row] = 0 if first[row] else end[row - 1]
                state, some = int(state), 0
                for c in own[:, row].tolist():
                    state = step(state, c)
                    some += state & 1
                    state >>= 1
                end[row], count[row] = state, some
                row += 1


def text_symbols(text: str, symbol: np.ndarray) -> np.ndarray:
    """Letters by number; a run of anything else is one blank."""
    s = symbol[code_points(text)]
    blank = s == symbol[0]  # NUL is no letter
    return s[~(blank & np.concatenate(([False], blank[:-1])))]


class Parser:
    """The automata of all languages over one alphabet of all their letters; built once in each Python worker."""

    def __init__(self, texts: tuple[tuple[str, str], ...]):
        self.names = [name for name, _ in texts]
        seen = np.zeros(0x110000, np.bool_)
        for _, t in texts:
            seen[code_points(t.lower())] = True
        known = np.flatnonzero(seen & letters())
        n = len(known)
        # a letter, a blank, a letter of no sample, and what fills a row
        self.symbol, self.fill = np.where(letters(), n + 1, n).astype(np.int32), n + 2
        for k, c in enumerate(known.tolist()):
            self.symbol[c] = k
        for k, c in enumerate(known.tolist()):
            for other in (chr(c).upper(), chr(c).title()):
                if len(other) == 1 and self.symbol[ord(other)] == n + 1:
                    self.symbol[ord(other)] = k
        self.languages = [Greedy(t, self.symbol, n, TABLE_BYTES // max(len(texts), 1)) for _, t in texts]

    def symbols(self, text: str) -> np.ndarray:
        return text_symbols(text, self.symbol)

    def phrases(self, sequences: list[np.ndarray], row: int = ROW) -> np.ndarray:
        """Phrases needed, for each sequence and language."""
        rows = np.array([-(-len(s) // row) for s in sequences], np.int64)
        grid = np.full((int(rows.sum()), row), self.fill, np.int32)
        start = np.cumsum(rows) - rows
        flat = grid.ravel()
        for s, a in zip(sequences, start.tolist(), strict=True):
            flat[a * row : a * row + len(s)] = s
        columns = np.ascontiguousarray(grid.T)
        first = np.zeros(len(grid), np.bool_)
        first[start[rows > 0]] = True
        owner = np.repeat(np.arange(len(sequences)), rows)
        return np.stack([np.bincount(owner, x.phrases(columns, first), len(sequences)).astype(np.int64) for x in self.languages], axis=1)

    def bits(self, sequences: list[np.ndarray]) -> np.ndarray:
        """The cross entropy of each sequence and language."""
        lacking = np.array([[np.count_nonzero(x.local[s] == x.other) for x in self.languages] for s in sequences])
        return self.phrases(sequences) * np.array([x.bits for x in self.languages]) + LITERAL * lacking

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.names:
            return out
        who = [k for k, t in enumerate(texts) if t and letters()[code_points(t)].any()]
        if not who:
            return out
        for k, row in zip(who, self.bits([self.symbols(texts[k]) for k in who]).tolist(), strict=True):
            order = sorted(zip(row, self.names, strict=True))
            best, second = order[0][0], (order[1][0] if len(order) > 1 else math.inf)
            out[k] = (order[0][1], 1.0 if second == math.inf else second / (best + second))
        return out


@lru_cache(maxsize=2)
def parser(texts: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(texts)


def predict(docs: DataFrame, texts: dict[str, str], rows: int = 256) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, by its text alone.

    The score is the second best language's share of the two best entropies: one
    half if nothing tells them apart, near 1 if the best is far better.
    """
    small_batches(docs.sparkSession, rows)
    known = tuple(sorted(texts.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(known)
        for batch in slices(batches, rows):
            found = p.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, PREDICTED)


def relabelled(docs: DataFrame, texts: dict[str, str]) -> DataFrame:
    """``docs`` with the predicted language as ``lang``, without the rows that have none (``und``)."""
    small_batches(docs.sparkSession)
    known = tuple(sorted(texts.items()))

    @F.pandas_udf("string")
    def predicted(column):
        import pandas as pd

        p, texts_ = parser(known), [t if isinstance(t, str) else None for t in column]
        return pd.Series([x for at in range(0, len(texts_), 256) for x, _ in p.predict(texts_[at : at + 256])], dtype=object)

    return docs.withColumn("lang", predicted(F.col("text").cast("string"))).filter("lang <> 'und'")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled rows and predict every row."""
    return predict(docs, sample(docs))
