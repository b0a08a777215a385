"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints that differ in at most three bits agree in one of four segments of
16 bits. So each fingerprint stands under four top nodes, one for each segment
(a masked bit pattern that all below it share). Under a top node the codes are
sorted by Gray rank, which puts codes with like leading bits side by side, and
an index is built bottom up: a node keeps the bits all its codes share, as mask
and pattern. Two nodes are compared by their patterns under the masks they
both have; the differences that this accumulates on the way down prune a pair
of groups as soon as they pass the radius, and a group whose unshared bits are
no more than the radius is linked whole. Only a spanning forest of the links
leaves a group, so groups of any density add at most a row a code.

A top node with more than ``MOST`` codes is divided again in the same way, by
four segments of the bits left, until its parts are small: exact at any size.

Defined results: a null text counts as empty; a text without words has
fingerprint zero and is linked as any other; equal fingerprints are always
linked. Rows that repeat an id are each fingerprinted. Rows with a null id are
linked but not named: a component is the smallest id in it, null if it has
none. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphgrid.llm.columns import each_index, let, unused, words
from glyphgrid.llm.components import connected_components
from glyphgrid.llm.exact_dedup import ascii_lower
from glyphgrid.session import discard, materialize, small_batches, tasks

SHINGLE, RADIUS = 3, 3
#: Codes under one top node before it is divided again.
MOST = 5_000
LEAF, FAN = 32, 8
SALTS = 32


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of the word shingles of a text, A-Z in lower case; 0 without words."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: A-Z, and blanks of ASCII, only
    if not words:
        return 0
    joined = b" ".join(words)
    stop = np.cumsum([len(w) + 1 for w in words]) - 1
    start = stop - np.array([len(w) for w in words])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    ones = np.zeros(64, np.int64)
    spans = list(zip(start[:n].tolist(), stop[k - 1 :].tolist(), strict=True))
    for at in range(0, n, 1 << 16):
        part = spans[at : at + (1 << 16)]
        h = np.fromiter((digest(joined[a:b], 42) for a, b in part), "<u8", len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row, the fingerprint as a signed 64-bit number."""
    small_batches(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class GrayIndex:
    """The hierarchical index over codes in Gray order."""

    def __init__(self, codes: np.ndarray, radius: int):
        self.codes, self.radius = codes, radius
        self.label = np.arange(len(codes))
        starts = np.arange(0, len(codes), LEAF)
        all_, any_ = np.bitwise_and.reduceat(codes, starts), np.bitwise_or.reduceat(codes, starts)
        self.levels = [(all_, ~(all_ ^ any_))]  # pattern and mask; leaves first
        while len(all_) > 1:
            starts = np.arange(0, len(all_), FAN)
            all_, any_ = np.bitwise_and.reduceat(all_, starts), np.bitwise_or.reduceat(any_, starts)
            self.levels.append((all_, ~(all_ ^ any_)))

    def merge(self, i: np.ndarray, j: np.ndarray) -> None:
        """Join the classes of linked codes; a label is the smallest position of its class."""
        label = self.label
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up

    def near(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pattern, mask = self.levels[level]
        return np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= self.radius

    def link(self) -> np.ndarray:
        """Link all codes within the radius; the label of each code."""
        n = len(self.codes)
        for level, (_, mask) in enumerate(self.levels):  # groups that are near throughout
            width = LEAF * FAN**level
            for k in np.nonzero(np.bitwise_count(~mask) <= self.radius)[0].tolist():
                inside = np.arange(k * width, min((k + 1) * width, n))
                self.merge(inside, np.full(len(inside), inside[0]))
        top = len(self.levels) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            fits = self.near(level, a, b)
            a, b = a[fits], b[fits]
            fan, below = (FAN, len(self.levels[level - 1][0])) if level else (LEAF, n)
            step = max(1, (1 << 18) // (fan * fan))
            for at in range(0, len(a), step):
                x = (a[at : at + step, None] * fan + np.arange(fan))[:, :, None]
                y = (b[at : at + step, None] * fan + np.arange(fan))[:, None, :]
                x, y = np.broadcast_arrays(x, y)
                good = (x < below) & (y < below) & (x <= y)
                x, y = x[good], y[good]
                if level:
                    stack.append((level - 1, x, y))
                else:
                    close = np.bitwise_count(self.codes[x] ^ self.codes[y]) <= self.radius
                    self.merge(x[close], y[close])
        return self.label


def gray_rank(code: Column) -> Column:
    """The place of a code in the Gray sequence."""
    for k in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, k))
    return code


def divided(codes: DataFrame, fixed: int, radius: int) -> DataFrame:
    """Each code once for each of radius + 1 segments of its lower 64 - ``fixed`` bits, rotated to stand first; ``node`` names the path."""
    left, parts = 64 - fixed, radius + 1
    cuts = [left * k // parts for k in range(parts + 1)]
    low = F.col("code") if not fixed else F.col("code").bitwiseAND(F.lit((1 << left) - 1))
    high = F.lit(0).cast("long") if not fixed else F.col("code").bitwiseAND(F.lit(-1 << left))
    rotations = []
    for k in range(parts):
        by, width = cuts[k], cuts[k + 1] - cuts[k]
        turned = low if not by else F.shiftleft(low, by).bitwiseOR(F.shiftrightunsigned(low, left - by))
        turned = turned if not fixed else turned.bitwiseAND(F.lit((1 << left) - 1))
        code = turned.bitwiseOR(high)
        segment = F.shiftrightunsigned(turned, left - width)
        segment = segment if width < 64 else turned
        rotations.append(F.struct(F.concat_ws("/", F.col("node"), F.lit(str(k)), segment.bitwiseAND(F.lit((1 << width) - 1)).cast("string")).alias("node"), code.alias("code"), F.lit(fixed + width).alias("fixed")))
    return codes.select("rep", F.explode(F.array(*rotations)).alias("r")).select("rep", "r.*")


def near_links(codes: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """(a, b): links whose classes are those of all pairs of ``codes`` (node, code, rep) of one node within the radius; b is the smallest of its class under a node."""
    waiting, ready = codes.select("rep", "code", "node"), []
    fixed = 0
    while True:
        placed = divided(waiting, fixed, radius)
        widest = 64 - fixed - (64 - fixed) * radius // (radius + 1)
        if widest <= 1:
            ready.append(placed)
            break
        placed = materialize(placed, "gray-nodes")
        crowded = materialize(placed.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("node"), "gray-crowded")
        if crowded.isEmpty():
            ready.append(placed)
            break
        ready.append(placed.join(crowded, "node", "left_anti"))
        waiting = placed.join(crowded, "node").select("rep", "code", "node")
        # segments may differ by a bit in width; the narrowest is fixed in all of them
        fixed += (64 - fixed) // (radius + 1)
    nodes = ready[0].select("node", "rep", "code")
    for more in ready[1:]:
        nodes = nodes.unionByName(more.select("node", "rep", "code"))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        name = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held and sum(len(x[0]) for x in held) > 1:
                reps, found = (np.concatenate(x) for x in zip(*held, strict=True))
                label = GrayIndex(found.view(np.uint64), radius).link()
                # the smallest id is a class's centre, under whatever node it is met, so that its stars coincide
                least = np.full(len(label), np.iinfo(np.int64).max)
                np.minimum.at(least, label, reps)
                centre = least[label]
                child = np.nonzero(reps != centre)[0]
                yield pa.RecordBatch.from_arrays([pa.array(reps[child]), pa.array(centre[child])], names=["a", "b"])
            held.clear()

        for batch in batches:
            names = batch.column(0).dictionary_encode()
            index = np.asarray(names.indices)
            cut = np.concatenate(([0], np.nonzero(np.diff(index))[0] + 1, [len(index)]))
            reps, found = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if e == s:
                    continue
                here = names.dictionary[int(index[s])].as_py()
                if here != name:
                    yield from flush()
                    name = here
                held.append((reps[s:e], found[s:e]))
        yield from flush()

    dealt = nodes.withColumn("rank", gray_rank(F.col("code"))).repartition(tasks(codes.sparkSession), "node").sortWithinPartitions("node", "rank").select("node", "rep", "code")
    return dealt.mapInArrow(links, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint and component_id (the smallest id reachable over links) of every row.

    Fingerprints are linked by numbers of their own, so that one whose rows have no
    id still links others; ids come to the components afterwards. A fingerprint may
    be that of a third of all rows, and a component may hold a third of all
    fingerprints; both meet in ``SALTS`` parts and get their answer the same way.
    """
    rows = materialize(fingerprints(docs, shingle), "fingerprints").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    parts = rows.groupBy("fp", "salt").agg(F.min("doc_id").alias("rep"))
    codes = materialize(parts.groupBy("fp").agg(F.min("rep").alias("rep")).withColumn("number", F.monotonically_increasing_id()), "codes")
    found = connected_components(near_links(codes.select(F.col("number").alias("rep"), F.col("fp").alias("code"), F.lit("").alias("node")), radius, most))
    of = codes.join(found, codes["number"] == found["node"], "left").select("fp", "rep", F.coalesce("component", "number").alias("component"), F.pmod(F.xxhash64("fp"), F.lit(SALTS)).alias("part"))
    of = materialize(of, "code-components")
    some = of.groupBy("component", "part").agg(F.min("rep").alias("rep"))
    least = some.select("component", "part").join(some.groupBy("component").agg(F.min("rep").alias("component_id")), "component")
    named = of.join(least, ["component", "part"]).select("fp", "component_id")
    discard(codes, found)
    back = parts.select("fp", "salt").join(named, "fp")
    return rows.join(back, ["fp", "salt"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Of each component the document with the smallest id, with all columns.

    Rows with one id are one document here: all go if one of them is a near copy
    of a smaller id. Rows without an id stay.
    """
    [name] = unused(docs, "gone")
    gone = near_duplicates(docs, shingle, radius).filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")


#: For copies by similarity: words of a shingle, and the least Jaccard similarity.
SIMILAR_SHINGLE, SIMILARITY = 5, 0.8
#: Bands of minima of the shingles, and minima in a band: a pair of similarity s shares none with probability (1 - s**BAND)**BANDS, 3e-6 at 0.8.
BANDS, BAND = 32, 5
#: Shingles of all members of a bucket that one task compares, and members of a larger one that all others are compared with first.
TOGETHER, REPS = 4_000_000, 4
REMEMBERED = 300_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


#: One for each minimum of a text.
BAND_SALTS = _mixed(np.arange(1, BANDS * BAND + 1, dtype=np.uint64))


def shingle_codes(text: str | None, hashes: dict[bytes, int], shingle: int = SIMILAR_SHINGLE) -> tuple[int, np.ndarray]:
    """The SimHash of a text's different shingles, and a hash of each band of their minima; equal sets have equal ones. ``hashes`` remembers words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if len(hashes) > REMEMBERED:
        hashes.clear()
    for w in words:
        if w not in hashes:
            hashes[w] = xxhash.xxh64_intdigest(w, 7)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(shingle, len(words))
    joined = np.zeros(max(1, len(words) - k + 1), np.uint64)
    for j in range(k):
        joined = _mixed(joined ^ h[j : j + len(joined)])
    joined = np.unique(joined)
    least, ones = np.full(BANDS * BAND, ~np.uint64(0)), np.zeros(64, np.int64)
    for at in range(0, len(joined), 1 << 13):
        part = joined[at : at + (1 << 13)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        for i in range(0, len(least), 16):
            np.minimum(least[i : i + 16], _mixed(part[None, :] ^ BAND_SALTS[i : i + 16, None]).min(axis=1), out=least[i : i + 16])
    code = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND).T:
        code = _mixed(code ^ column)
    return int(np.packbits(2 * ones > len(joined), bitorder="little").view("<u8")[0]), code


def similar_codes(docs: DataFrame, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """(doc_id, fp, bands): fingerprint and band codes of every row with an id."""
    small_batches(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[bytes, int] = {}
        for batch in batches:
            found = [shingle_codes(t.as_py(), hashes, shingle) for t in batch.column(1)]
            fp = np.array([f for f, _ in found], np.uint64).view(np.int64)
            codes = np.concatenate([c for _, c in found]) if found else np.zeros(0, np.uint64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * BANDS), pa.array(codes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), bands], names=["doc_id", "fp", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, fp long, bands array<long>")


def shingle_hashes(text: Column, k: int = SIMILAR_SHINGLE) -> Column:
    """Hashes of the different k-word shingles (A-Z in lower case); of a shorter text, of all its words."""

    def of(ws: Column) -> Column:
        n = F.size(ws)
        long_ = F.transform(each_index(n - (k - 1)), lambda i: F.xxhash64(*(F.get(ws, i + j) for j in range(k))))
        return F.when(n >= k, F.array_distinct(long_)).otherwise(F.array(F.xxhash64(F.array_join(ws, " "))))

    return let(words(ascii_lower(F.coalesce(text.cast("string"), F.lit("")))), of)


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (doc, rep) whose ``sets`` (doc_id, s) are as similar as asked, again for every text of an id."""
    own = pairs.join(sets.select(F.col("doc_id").alias("doc"), "s"), "doc")
    both = own.join(sets.select(F.col("doc_id").alias("rep"), F.col("s").alias("rs")), "rep")
    shared = F.size(F.array_intersect("s", "rs"))
    return both.filter(shared >= similarity * (F.size("s") + F.size("rs") - shared)).select("doc", "rep")


def similar_copies(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SIMILAR_SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, kept_id): documents that go, each with the smallest id of its group.

    A group is a connected part of the links between texts that share as much of
    their shingles as asked. Candidates lie in one bucket: fingerprints that the
    Gray-order index links, or an equal band of minima of the shingles, which a
    pair as similar as asked has whatever was edited, cut off or appended. First
    each document is compared with the smallest id of all its buckets. Then what
    of a bucket does not lie in its largest group yet is compared with all members
    of other groups, by the shingles they hold, in one task if they have at most
    ``TOGETHER``; a spanning forest of the links leaves it. Of larger buckets all
    are compared with the ``REPS`` that have most links, or are first by a hash,
    and what this leaves apart with all members of other groups that it shares one of
    its rarest shingles with, as every pair as similar as asked does: no pair of a bucket is lost.

    Rows with one id are one document, similar to others if one of its texts is;
    rows without an id have no copies. Empty texts are equal texts.
    """
    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    codes = materialize(similar_codes(docs, shingle), "shingle-codes")
    distinct = codes.groupBy(F.col("fp").alias("code")).agg(F.min("doc_id").alias("rep")).withColumn("node", F.lit(""))
    gray = materialize(near_links(distinct, radius).distinct(), "gray-links")
    bands = codes.select("doc_id", F.explode("bands").alias("key"))
    printed = codes.select("doc_id", F.xxhash64(F.lit("print"), F.col("fp")).alias("key"))
    linked = gray.select(F.explode(F.array("a", "b")).alias("doc_id"), F.xxhash64(F.lit("gray"), F.col("b")).alias("key")).distinct()
    entries = bands.withColumn("band", F.lit(True)).union(printed.union(linked).withColumn("band", F.lit(False)))
    shared = entries.groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).filter("rep < last").select("key", "rep")
    met = materialize(entries.join(shared, "key"), "met")
    sets = materialize(rows.join(met.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", shingle_hashes(F.col("text"), shingle).alias("s")), "shingles")
    pairs = materialize(met.filter("doc_id <> rep").groupBy(F.col("doc_id").alias("doc")).agg(F.min("rep").alias("rep")), "pairs")
    tested = [pairs]
    edges = materialize(similar_pairs(pairs, sets, similarity), "similar")
    groups = connected_components(edges.toDF("a", "b"))
    # bands alone are gone on with, as they hold every pair
    members = open_members(met.filter("band").select("key", "doc_id"), groups)
    weights = members.join(sets.select("doc_id", F.size("s").alias("n")), "doc_id").groupBy("key").agg(F.sum("n").alias("weight"))
    members = materialize(members.join(weights, "key"), "members")
    found = linked_within(members.filter(F.col("weight") <= TOGETHER).join(sets, "doc_id"), similarity)
    many = members.filter(F.col("weight") > TOGETHER)
    more = not many.isEmpty()
    if more:
        links = edges.select(F.explode(F.array("doc", "rep")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("links"))
        best = Window.partitionBy("key").orderBy(F.desc("links"), F.xxhash64("key", "doc_id"), "doc_id")
        ranked = many.join(links, "doc_id", "left").withColumn("links", F.coalesce("links", F.lit(0))).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= REPS)
        asked = ranked.select("key", F.col("doc_id").alias("other"), F.col("component").alias("of"))
        both = many.join(asked, "key").filter("component <> of").select(F.greatest("doc_id", "other").alias("doc"), F.least("doc_id", "other").alias("rep")).distinct()
        tested.append(materialize(both.join(pairs, ["doc", "rep"], "left_anti"), "pairs"))
        found = found.union(similar_pairs(tested[-1], sets, similarity))
    groups = joined_by(groups, found)
    if more:
        # of a bucket of no more than REPS members all pairs have been compared
        apart = open_members(many.filter(F.col("size") > REPS).select("key", "doc_id"), groups)
        tested.append(materialize(sharing_pairs(apart.join(sets, "doc_id"), similarity), "pairs"))
        groups = joined_by(groups, similar_pairs(tested[-1], sets, similarity))
    discard(codes, gray, met, sets, members, *tested)
    return groups.filter("node <> component").select(F.col("node").alias("doc_id"), F.col("component").alias("kept_id"))


def joined_by(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups`` with those of linked members (doc, rep) made one."""
    found = materialize(links, "similar")
    if found.isEmpty():
        return groups
    joined = connected_components(groups.toDF("a", "b").union(found.toDF("a", "b")))
    discard(groups, found)
    return joined


def sharing_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """(doc, rep): all pairs of a bucket's members (key, doc_id, component, asks, s) that can be as similar as asked, one of them outside the largest group.

    Sets of which n shingles or fewer may be missing in the other share one of their n + 1 rarest ones, and are of
    like size. So the pairs come from a join by shingle, and neither a bucket nor a pair of parts of it is in one task.
    """
    held = members.select("key", "doc_id", "component", "asks", F.xxhash64("s").alias("text"), F.size("s").alias("n"), F.explode("s").alias("shingle"))
    held = held.withColumn("count", F.count("*").over(Window.partitionBy("key", "shingle")))
    rarest = Window.partitionBy("key", "doc_id", "text").orderBy("count", "shingle")
    most = F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1
    rare = held.withColumn("rank", F.row_number().over(rarest)).filter((F.col("rank") <= most) & (F.col("count") > 1)).select("key", "shingle", "doc_id", "component", "asks", "n")
    other = rare.select("key", "shingle", *(F.col(c).alias(f"other_{c}") for c in ("doc_id", "component", "n")))
    like = (F.least("n", "other_n") >= similarity * F.greatest("n", "other_n") - 1e-9) & (F.col("component") != F.col("other_component"))
    met = rare.filter("asks").join(other, ["key", "shingle"]).filter(like)
    return met.select(F.greatest("doc_id", "other_doc_id").alias("doc"), F.least("doc_id", "other_doc_id").alias("rep")).distinct()


def linked_within(members: DataFrame, similarity: float) -> DataFrame:
    """(doc, rep): links that join the groups of every bucket's members (key, doc_id, component, asks, s), as all links of as similar sets do."""

    def joined(ids: np.ndarray, group: np.ndarray, asks: np.ndarray, size: np.ndarray, flat: np.ndarray) -> list[tuple[int, int]]:
        _, held = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(len(ids)), size)
        order = np.argsort(held, kind="stable")
        holders, cut = owner[order], np.concatenate(([0], np.cumsum(np.bincount(held))))
        start, out = np.concatenate(([0], np.cumsum(size))), []
        for i in np.flatnonzero(asks).tolist():
            shared = np.bincount(np.concatenate([holders[cut[t] : cut[t + 1]] for t in held[start[i] : start[i + 1]].tolist()]), minlength=len(ids))
            for j in np.flatnonzero((shared >= similarity * (size[i] + size - shared)) & (group != group[i])).tolist():
                if group[j] != group[i]:
                    out.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
                    group[group == group[j]] = group[i]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now = None

        def flush() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                ids, group, asks, sets = zip(*rows, strict=True)
                found = joined(np.array(ids), np.array(group), np.array(asks), np.array([len(x) for x in sets]), np.concatenate(sets))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([int(x) for x in c], pa.int64()) for c in zip(*found, strict=True)], names=["doc", "rep"])
            rows.clear()

        for batch in batches:
            key, ids, group, asks = (batch.column(k).to_pylist() for k in range(4))
            sets = batch.column(4)
            offset, flat = np.asarray(sets.offsets), np.asarray(sets.values)
            for k in range(len(key)):
                if key[k] != now:
                    yield from flush()
                    now = key[k]
                rows.append((ids[k], group[k], asks[k], flat[offset[k] : offset[k + 1]]))
        yield from flush()

    return members.select("key", "doc_id", "component", "asks", "s").repartition(tasks(members.sparkSession), "key").sortWithinPartitions("key").mapInArrow(run, "doc long, rep long")


def open_members(buckets: DataFrame, groups: DataFrame) -> DataFrame:
    """``buckets`` (key, doc_id) that are not in one group, with each member's ``component``, ``asks``: is it not in the bucket's largest, ``apart``, how many are not, and ``size``."""
    named = buckets.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    sizes = named.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max_by("component", "n").alias("largest"), (F.sum("n") - F.max("n")).alias("apart"), F.sum("n").alias("size")).filter("apart > 0")
    return named.join(largest, "key").withColumn("asks", F.col("component") != F.col("largest")).drop("largest")


def drop_similar_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without copies by similarity; rows without an id stay."""
    [name] = unused(docs, "gone")
    gone = similar_copies(docs, similarity).select(F.col("doc_id").alias(name))
    return docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")
