"""Ordered alignment: all values of a page, in order, against the whole page text at once.

Python finds one cheapest edit path of a page's two texts and returns its runs of
characters; whose words these are, spans and their edges are joins, sums and
column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphgrid.functions.text import length_without_blanks
from glyphgrid.operators.candidates import accepted, for_values, in_order
from glyphgrid.operators.labels import require
from glyphgrid.operators.orthogonal import once
from glyphgrid.operators.textindex import norm_text, raw_text

SOURCE = "ordered-alignment"
#: Characters in a bin, by which runs meet values and words.
BIN = 256
#: Edits up to which a page's path is searched edit by edit (their square is kept).
EDITS = 1024
RUN = "page_key string, source_at int, target_at int, n int, same boolean"
FAR = np.int32(1 << 29)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Band:
    """Edit distances of prefixes within ``reach`` of the diagonal: row i has column j at j - i + reach.

    Neighbours in a row differ by one at most, so a row is kept as its first value
    and a byte for each step.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, reach: int):
        self.a, self.m, self.reach = a, len(b), reach
        self.offset = np.arange(2 * reach + 1, dtype=np.int32)
        self.padded = np.concatenate((np.full(reach + 1, 0xFFFFFFFF, np.uint32), b, np.full(reach + 1 + max(0, len(a) - len(b)), 0xFFFFFFFF, np.uint32)))

    def limits(self, i: int) -> tuple[int, int]:
        """The places of a row that are columns of the table."""
        return max(0, self.reach - i), min(2 * self.reach, self.m - i + self.reach)

    def first(self) -> np.ndarray:
        return np.where((self.offset >= self.reach) & (self.offset - self.reach <= self.m), self.offset - self.reach, FAR).astype(np.int32)

    def rows(self, i: int, row: np.ndarray, stop: int) -> Iterator[tuple[int, np.ndarray]]:
        """Row i, which is given, and those after it up to ``stop``."""
        yield i, row
        while i < stop:
            i += 1
            above = np.empty_like(row)
            above[:-1], above[-1] = row[1:], FAR
            across = row + (self.padded[i : i + len(row)] != self.a[i - 1])
            row = np.minimum(above + 1, across)
            low, high = self.limits(i)
            row[:low] = FAR
            if i <= self.reach:
                row[low] = i  # nothing of the target is used
            row[high + 1 :] = FAR
            row = np.minimum.accumulate(row - self.offset) + self.offset  # insertions run along the row
            row[:low], row[high + 1 :] = FAR, FAR
            yield i, row

    def packed(self, i: int, row: np.ndarray) -> tuple[int, np.ndarray]:
        low, high = self.limits(i)
        return int(row[low]), np.diff(row[low : high + 1]).astype(np.int8)

    def unpacked(self, i: int, kept: tuple[int, np.ndarray]) -> np.ndarray:
        row, (low, high) = np.full(len(self.offset), FAR, np.int32), self.limits(i)
        row[low] = kept[0]
        row[low + 1 : high + 1] = kept[0] + np.cumsum(kept[1], dtype=np.int32)
        return row


def reaches(n: int, m: int) -> Iterator[int]:
    reach = max(8, abs(n - m) + 1)
    while reach < max(n, m):
        yield reach
        reach *= 2
    yield max(n, m, 1)


def alike(a: np.ndarray, b: np.ndarray, step: int = 32) -> int:
    """How many codes two texts begin with in common."""
    most, at = min(len(a), len(b)), 0
    while at < most:
        unlike = a[at : min(at + step, most)] != b[at : min(at + step, most)]
        k = int(unlike.argmax())
        if unlike[k]:
            return at + k
        at, step = at + len(unlike), 4 * step
    return most


def furthest(a: np.ndarray, b: np.ndarray, most: int) -> list[np.ndarray] | None:
    """For 0, 1, ... edits, how far in ``a`` each diagonal -edits..edits is reached with as many; None if the texts take more than ``most``."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    far = [np.array([alike(a, b)])]
    while not (abs(m - n) < len(far) and far[-1][m - n + len(far) - 1] >= n):
        d = len(far)
        if d > most:
            return None
        none, last = np.full(2, -n - m - 2), far[-1]
        replaced, deleted, inserted = np.concatenate((none[:1], last + 1, none[:1])), np.concatenate((last + 1, none)), np.concatenate((none, last))
        k = np.arange(-d, d + 1)
        now = np.minimum(np.maximum(np.maximum(replaced, deleted), inserted), np.minimum(n, m - k))
        open_ = np.flatnonzero((now >= 0) & (now < n) & (now + k >= 0) & (now + k < m))
        for x in open_[a[now[open_]] == b[now[open_] + k[open_]]].tolist():
            now[x] += alike(a[now[x] :], b[now[x] + x - d :])
        far.append(now)
    return far


def few_edits(a: np.ndarray, b: np.ndarray, found: np.ndarray, most: int) -> bool:
    """Fill ``found`` as :func:`aligned_characters` says if ``most`` edits do; time grows with the square of the edits, not with the length times the band."""
    far = furthest(a, b, most)
    if far is None:
        return False
    i, j, d = len(a), len(b), len(far) - 1
    within = lambda i, j, d: abs(j - i) <= d and i <= far[d][j - i + d]
    while i and j:
        # a match is always on a cheapest path
        same = alike(a[:i][::-1], b[:j][::-1])
        found[i - same : i] = np.arange(j - same, j)
        i, j = i - same, j - same
        if not i or not j:
            break
        d -= 1
        if within(i - 1, j - 1, d):
            i, j = i - 1, j - 1
            found[i] = j
        elif within(i - 1, j, d):
            i -= 1
        else:
            j -= 1
    return True


def aligned_characters(source: str, target: str) -> np.ndarray:
    """For each source character the target character it is matched with or replaced by, or -1.

    One cheapest edit path, walked from the end; of equal steps a match goes
    first, then a replacement, a deletion, an insertion. Texts with few edits are
    searched edit by edit; for others the band around the
    diagonal is doubled until the path cannot leave it. Of its rows one in as many
    as the root of their number is kept, and those between are worked out again
    when the walk gets there, so memory grows with the root of the length times
    the band.
    """
    a, b = codes(source), codes(target)
    found = np.full(len(a), -1, np.int64)
    same = min(len(a), len(b))
    unlike = np.flatnonzero(a[len(a) - same :][::-1] != b[len(b) - same :][::-1])
    tail = int(unlike[0]) if len(unlike) else same
    i, j = len(a) - tail, len(b) - tail
    found[i:] = np.arange(j, len(b))
    if not i or not j:
        return found
    if few_edits(a[:i], b[:j], found, min(EDITS, max(64, 4 * math.isqrt(i)))):
        return found
    step = max(16, math.isqrt(i))
    for reach in reaches(i, j):
        band, marks = Band(a[:i], b[:j], reach), {}
        for k, row in band.rows(0, band.first(), i):
            if k % step == 0:
                marks[k] = band.packed(k, row)
        if row[j - i + reach] <= reach:
            break
    block: list[tuple[int, np.ndarray]] = []
    base, here = i + 1, row
    while i and j:
        if i - 1 < base:
            base = (i - 1) // step * step
            block = [band.packed(k, r) for k, r in band.rows(base, band.unpacked(base, marks[base]), i - 1)]
        above = band.unpacked(i - 1, block[i - 1 - base])
        while j:
            at = j - i + reach
            now, across = here[at], above[at]
            if across + (a[i - 1] != b[j - 1]) == now:
                i, j = i - 1, j - 1
                found[i] = j
                break
            if at < 2 * reach and above[at + 1] + 1 == now:
                i -= 1
                break
            j -= 1
        here = above
    return found


def runs(source: str, target: str) -> list[tuple[int, int, int, bool]]:
    """(source place, target place, length, equal) of the runs of characters that are matched, or replaced, one after the other."""
    to = aligned_characters(source, target)
    at = np.flatnonzero(to >= 0)
    if not len(at):
        return []
    same = codes(source)[at] == codes(target)[to[at]]
    new = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(to[at]) != 1) | (same[1:] != same[:-1])))
    first = np.flatnonzero(new)
    return list(zip(at[first].tolist(), to[at[first]].tolist(), np.diff(np.append(first, len(at))).tolist(), same[first].tolist(), strict=True))


def page_runs(texts: DataFrame) -> DataFrame:
    """``RUN`` of every page (page_key, source, target). A page's texts are one row, as their alignment is one path."""
    schema = pa.schema([("page_key", pa.string()), ("source_at", pa.int32()), ("target_at", pa.int32()), ("n", pa.int32()), ("same", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, source, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = [(key, *r) for r in runs(source, target)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    return texts.select("page_key", "source", "target").mapInArrow(run, RUN)


def meeting(pieces: DataFrame, owners: DataFrame, at: str) -> DataFrame:
    """``pieces`` (with places [``at``, ``at`` + n)) cut by the ``owners`` (page_key, own_from, own_to, ...) of their page.

    Both are dealt to bins of ``BIN`` characters and meet in the first that both
    touch, so a page of any length is many keys.
    """
    bins = lambda start, end: F.explode(F.sequence(F.floor(start / BIN), F.floor((end - 1) / BIN)))
    left = pieces.withColumn("bin", bins(F.col(at), F.col(at) + F.col("n")))
    right = owners.withColumn("bin", bins(F.col("own_from"), F.col("own_to")))
    begin, end = F.greatest(at, "own_from"), F.least(F.col(at) + F.col("n"), F.col("own_to"))
    met = left.join(right, ["page_key", "bin"]).filter((begin < end) & (F.col("bin") == F.floor(begin / BIN)))
    moved = {c: F.col(c) + (begin - F.col(at)) for c in ("source_at", "target_at")}
    return met.select(*(x for x in met.columns if x not in ("bin", "own_from", "own_to", "source_at", "target_at", "n")), *(c.alias(n) for n, c in moved.items()), (end - begin).alias("n"))


def owned_words(values: DataFrame, index: DataFrame) -> DataFrame:
    """(page_key, region_id, start_word, end_word): from the first to the last word whose characters are most a value's."""
    order = Window.partitionBy("page_key").orderBy("region_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = values.withColumn("own_from", F.coalesce(F.sum(F.length("norm") + 1).over(order), F.lit(0)))
    placed = placed.select("page_key", "region_id", "norm", "own_from", (F.col("own_from") + F.length("norm")).alias("own_to"))
    words = index.filter("norm <> ''")
    joined = lambda df, by: df.groupBy("page_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "norm"))), lambda x: x["norm"]), " ").alias("t"))
    texts = joined(placed, "region_id").withColumnRenamed("t", "source").join(joined(words, "word_index").withColumnRenamed("t", "target"), "page_key")
    of_values = meeting(page_runs(texts), placed.select("page_key", "region_id", "own_from", "own_to"), "source_at")
    of_words = meeting(of_values, words.select("page_key", "word_index", F.col("char_start").alias("own_from"), F.col("char_end").alias("own_to")), "target_at")
    votes = of_words.groupBy("page_key", "word_index", "region_id").agg(F.sum(F.when(F.col("same"), 2 * F.col("n")).otherwise(F.col("n"))).alias("votes"))
    best = Window.partitionBy("page_key", "word_index").orderBy(F.desc("votes"), "region_id")
    return votes.withColumn("rank", F.row_number().over(best)).filter("rank = 1").groupBy("page_key", "region_id").agg(F.min("word_index").alias("start_word"), F.max("word_index").alias("end_word"))


def distance(a: Column, b: Column) -> Column:
    """The edit distance; equal and near texts in time that grows with their length, not its square."""
    within = lambda most: F.call_function("levenshtein", a, b, F.lit(most))
    return F.when(a == b, F.lit(0)).otherwise(once(within(8), lambda x: F.when(x >= 0, x).otherwise(once(within(64), lambda y: F.when(y >= 0, y).otherwise(F.levenshtein(a, b))))))


def trimmed(query: Column, part: Column) -> Column:
    """(from, to, distance): the words that stay of ``part`` when edge words go as long as the value gets nearer without them, the first one first."""
    rest = lambda s, e: norm_text(F.slice(part, s + 1, e - s + 1))
    far = F.lit(1 << 30)
    # only what is nearer than the state's distance counts, so the rest need not be worked out
    nearer_than = lambda s, e, d: once(F.call_function("levenshtein", query, rest(s, e), d - 1), lambda x: F.when(x < 0, far).otherwise(x))
    state = lambda s, e, d, more: F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"), d.cast("int").alias("d"), more.alias("more"))

    def without_edge(x: Column) -> Column:
        def nearer(left: Column, right: Column) -> Column:
            stays = state(x["s"], x["e"], x["d"], F.lit(False))
            shorter = F.when(left <= right, state(x["s"] + 1, x["e"], left, F.lit(True))).otherwise(state(x["s"], x["e"] - 1, right, F.lit(True)))
            return F.when(F.least(left, right) >= x["d"], stays).otherwise(shorter)

        both = F.struct(nearer_than(x["s"] + 1, x["e"], x["d"]).alias("l"), nearer_than(x["s"], x["e"] - 1, x["d"]).alias("r"))
        return F.when(x["more"] & (x["d"] > 0) & (x["s"] < x["e"]), once(both, lambda b: nearer(b["l"], b["r"]))).otherwise(x)

    last = F.size(part) - 1
    return F.aggregate(part, state(F.lit(0), last, distance(query, norm_text(part)), F.lit(True)), lambda x, _: without_edge(x))


def ordered_candidates(values: DataFrame, index: DataFrame, boundary: int = 6, max_cer: float = 0.20, max_edits: int = 1) -> DataFrame:
    """One candidate at most a value, in reading order; spans that overlap are an error."""
    require(boundary > 0 and 0 <= max_cer <= 1 and max_edits >= 0, "ordered alignment limits are out of range")
    slim = values.filter("norm <> ''").select("page_key", "region_id", "norm")
    spans = owned_words(slim, index)
    words = index.select("page_key", "word_index", "text", "norm", "char_start", "char_end")
    inside = spans.withColumn("word_index", F.explode(F.sequence("start_word", "end_word"))).join(words, ["page_key", "word_index"])
    lists = inside.groupBy("page_key", "region_id").agg(F.array_sort(F.collect_list(F.struct("word_index", "text", "norm", "char_start", "char_end"))).alias("part"))
    named = lists.join(slim.withColumnRenamed("norm", "query"), ["page_key", "region_id"]).withColumn("cut", trimmed(F.col("query"), F.col("part")))
    kept = named.withColumn("part", F.slice("part", F.col("cut.s") + 1, F.col("cut.e") - F.col("cut.s") + 1))
    first, last = F.element_at("part", 1), F.element_at("part", -1)
    texts = kept.filter((first["norm"] != "") & (last["norm"] != "")).select(
        "page_key", "region_id", "query", first["word_index"].alias("start_word"), last["word_index"].alias("end_word"), F.col("cut.d").alias("edit_distance"),
        first["char_start"].alias("start_char"), last["char_end"].alias("end_char"),
        raw_text(F.col("part")).alias("matched_text"), norm_text(F.col("part")).alias("normalized_matched_text"), F.lit(SOURCE).alias("source"),
    )
    good = texts.filter(accepted(F.col("edit_distance"), F.length("query"), length_without_blanks(F.col("query")), boundary, max_cer, max_edits))
    return checked(for_own_values(values, good))


def for_own_values(values: DataFrame, spans: DataFrame) -> DataFrame:
    """As ``for_values``, for spans that belong to one value each."""
    keyed = spans.withColumn("page", F.col("page_key")).withColumn("page_key", F.concat_ws("\u001f", "page_key", F.col("region_id").cast("string"))).drop("region_id")
    own = values.withColumn("page_key", F.concat_ws("\u001f", "page_key", F.col("region_id").cast("string")))
    found = for_values(own, keyed.drop("page"))
    return in_order(found.withColumn("page_key", F.regexp_extract("page_key", "(?s)^(.*)\u001f", 1)))


def checked(candidates: DataFrame) -> DataFrame:
    """The candidates, or an error where two of a page share a word."""
    before = Window.partitionBy("page_key").orderBy("start_word", "region_id").rowsBetween(Window.unboundedPreceding, -1)
    clash = F.max("end_word").over(before) >= F.col("start_word")
    fine = F.when(clash, F.raise_error(F.concat(F.lit("ordered alignment gave overlapping spans on page "), "page_key"))).otherwise(F.lit(True))
    return candidates.withColumn("fine", fine.cast("boolean")).filter("fine").drop("fine")
