"""Merkle manifest of a table: one tree a language, one tree over the languages' roots.

Rows are hashed where they lie. Sorted ranges give every leaf its place in the
tree of its language, however much of the table one language holds. Aligned blocks
of ``1 << LEVELS`` leaves are then walked apart: the postorder recursion over a
block returns the digest of a subtree and, while it unwinds, appends the sibling
to every leaf below. The roots of the blocks are the leaves of the next, equal
traversal, until every tree has one root; the roots of the trees, in order, are
the leaves of the last tree. Proofs are put together from the top down, so that a
block root meets the at most ``1 << LEVELS`` nodes below it and no more.

Defined results: a null value of any column is written ``-``; a null language has
a tree of its own, the first; rows without an id come first in their tree and are
not tampered with. Rows that repeat an id are ordered by their digest, equal rows
are leaves of their own. A lone leaf is its tree's root and has no sibling. A text
of any length is one leaf. An empty table gives an empty manifest. Columns of
other names than the five read do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphgrid.session import discard, materialize, tasks

#: Levels of one traversal; a block has up to two to this power nodes.
LEVELS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One document in so many is changed to show that the manifest finds it.
TAMPER_EVERY = 7


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def preimage(values: list[Column]) -> Column:
    """Every value as its length in bytes, a colon and the value; ``-`` for null."""
    said = [v.cast("string") for v in values]
    return F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in said))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, tree, leaf, tampered) a row; ``tampered`` is the digest after the change, null where nothing changes."""
    values = {name: F.col(name) for name in FIELDS}
    changed = values | {"n_chars": F.col("n_chars") + 1}
    hit = F.col("n_chars").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % TAMPER_EVERY == 0)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"),
        F.sha2(preimage([*values.values()]), 256).alias("leaf"),
        F.when(hit, F.sha2(preimage([*changed.values()]), 256)).alias("tampered"),
    )


def placed(nodes: DataFrame, *order: str) -> DataFrame:
    """``nodes`` with ``place`` in their ``tree`` by ``order`` and the tree's ``size``.

    Rows are sorted in ranges; each range counts its rows of each tree, and running
    totals over the ranges (one row a range and tree) give where they start. Equal
    rows are told apart by where they were read, so ranges can cut between them.
    """
    keys = ["tree", *order, "salt"]
    rows = nodes.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(tasks(nodes.sparkSession), *keys)
    laid = materialize(rows.sortWithinPartitions(*keys).drop("salt").withColumn("at", F.monotonically_increasing_id()), "laid")
    laid = laid.withColumn("range", F.shiftright("at", 33))
    starts = laid.groupBy("tree", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    sized = starts.groupBy("tree").agg(F.sum("n").alias("size"), F.sort_array(F.collect_list(F.struct("range", "first", "n"))).alias("ranges"))
    counted = sized.select("tree", "size", F.aggregate("ranges", F.array().cast("array<struct<range:bigint,shift:bigint,next:bigint>>"), lambda done, r: F.concat(done, F.array(after(done, r)))).alias("ranges"))
    shifts = counted.select("tree", "size", F.inline("ranges"))
    found = materialize(laid.join(shifts.drop("next"), ["tree", "range"]).withColumn("place", F.col("at") + F.col("shift")).drop("at", "range", "shift"), "placed")
    discard(laid)
    return found


def after(done: Column, r: Column) -> Column:
    """The range ``r`` with what its numbering must be shifted by to go on behind the ranges before it."""
    start = F.coalesce(F.try_element_at(done, F.lit(-1))["next"], F.lit(0).cast("long"))
    return F.struct(r["range"].alias("range"), (start - r["first"]).alias("shift"), (start + r["n"]).alias("next"))


def walk(digests: list[str], first: int, last: int, height: int, siblings: list[list[bytes]]) -> str:
    """The digest of the subtree over ``digests[first:last]``, in postorder.

    On the way back every leaf below gets the sibling of the child it lies in: a
    byte 0 before a sibling on the left, 1 before one on the right, and nothing at
    all where the child is alone.
    """
    if height == 0:
        return digests[first]
    middle = first + (1 << (height - 1))
    left = walk(digests, first, min(middle, last), height - 1, siblings)
    if middle >= last:
        for mine in siblings[first:last]:
            mine.append(b"")
        return sha256(left)
    right = walk(digests, middle, last, height - 1, siblings)
    for mine in siblings[first:middle]:
        mine.append(b"\1" + bytes.fromhex(right))
    for mine in siblings[middle:last]:
        mine.append(b"\0" + bytes.fromhex(left))
    return sha256(left + right)


def block_walk(levels: int) -> Callable[[pa.Table], pa.Table]:
    """One block: its nodes with their siblings, its root on the first node."""

    def walked(block: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        digests, size = block.column("digest").to_pylist(), block.column("size")[0].as_py()
        # the only block of a tree ends at its root; others reach the height of whole blocks
        height = (len(digests) - 1).bit_length() if size <= 1 << levels else levels
        siblings: list[list[bytes]] = [[] for _ in digests]
        root = walk(digests, 0, len(digests), height, siblings)
        block = block.append_column("siblings", pa.array(siblings, pa.list_(pa.binary())))
        return block.append_column("block_root", pa.array([root] + [None] * (len(digests) - 1), pa.string()))

    return walked


def climb(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The traversals from ``nodes`` (tree, place, size, digest and more) up to one root a tree."""
    done = []
    most = nodes.agg(F.max("size")).first()[0] or 0
    while True:
        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields) + ", siblings array<binary>, block_root string"
        done.append(materialize(nodes.groupBy("tree", F.shiftright("place", levels)).applyInArrow(block_walk(levels), kind), "blocks"))
        most = -(-most >> levels)
        if most <= 1:
            return done
        above = done[-1].filter("block_root IS NOT NULL")
        nodes = above.select("tree", F.shiftright("place", levels).alias("place"), F.ceil(F.col("size") / (1 << levels)).alias("size"), F.col("block_root").alias("digest"))


def completed(traversals: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """The lowest nodes with all their siblings, up to the root; ``tops`` has the rest of the way (``above``) for each tree."""
    full = traversals[-1].join(tops, "tree")
    for lower in reversed(traversals[:-1]):
        upper = full.select(F.col("tree").alias("t"), F.col("place").alias("b"), *tops.drop("tree", "above").columns, F.concat("siblings", "above").alias("above"))
        full = lower.join(upper, (F.col("tree") == F.col("t")) & (F.shiftright("place", levels) == F.col("b"))).drop("t", "b")
    return full.withColumn("siblings", F.concat("siblings", "above")).drop("above", "block_root")


def folded(start: Column, siblings: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    said = F.transform(siblings, lambda s: F.lower(F.hex(s)))

    def up(digest: Column, s: Column) -> Column:
        other = F.substring(s, 3, 64)
        return F.sha2(F.when(s == "", digest).when(s.startswith("00"), F.concat(other, digest)).otherwise(F.concat(digest, other)), 256)

    return F.aggregate(said, start, up)


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One row a document: its leaf, the root of its language, the root of all, a digest of its proof and whether it folds to the root.

    Proofs are folded from the leaf as :func:`leaves` tampers with it.
    """
    low = climb(placed(leaves(docs), "doc_id", "leaf").withColumnRenamed("leaf", "digest"), levels)
    roots = low[-1].filter("block_root IS NOT NULL").select("tree", F.col("block_root").alias("digest"))
    forest = placed(roots.select(F.lit("").alias("tree"), F.col("tree").alias("member"), "digest"), "member")
    high = climb(forest, levels)
    root = high[-1].filter("block_root IS NOT NULL").select("tree", F.col("block_root").alias("root"), F.array().cast("array<binary>").alias("above"))
    tops = completed(high, root, levels).select(F.col("member").alias("tree"), F.col("digest").alias("subroot"), "root", F.col("siblings").alias("above"))
    full = completed(low, tops, levels)
    others = F.transform(F.filter("siblings", lambda s: F.length(s) > 0), lambda s: F.lower(F.hex(F.substring(s, 2, 32))))
    return full.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        F.sha2(F.array_join(others, ""), 256).alias("proof_sha256"),
        folded(F.coalesce("tampered", "digest"), F.col("siblings")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
