"""Mixing sources to target weights by Pfair scheduling; DataFrame functions only.

Target weights are multiples of 1/period. Block j (from 0) of a source of
weight w may not run before slot floor(j / w), its release, and must have run
by slot ceil((j + 1) / w), its deadline; every slot runs the released block
with the earliest deadline. As the weights sum to one, every deadline is met
and at every slot each source has had its weight's share to within less than
one block.

A source with a target of at least 1/``PERIOD`` is scheduled by itself. Smaller
ones whose targets lie within a factor of ``GRID`` are one kind with one weight,
which is their mean, and take the kind's blocks in turn: block j of its s-th of m
members is block j * m + s of the kind, whose window lies within the member's own,
so that members deviate by less than a block too. Whatever the number of sources,
there are at most ``PERIOD`` of the first sort and some hundred kinds, and the
period, ``PERIOD`` or ``SLOTS`` for each of them if that is more, is bounded; the
schedule of one period is worked out on the driver from the kinds' weights alone,
and every block of a source finds its slot by arithmetic.

A source that runs dry leaves its slots empty and the others go on in order;
``on_target`` marks the slots before the first such gap. No document is dropped
or repeated; a source without a target gets some slots too.

Defined results: null sources are one source, the empty name. Rows that repeat
an id each have a place. An empty table gives an empty result. In
the plain form only id and source are read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphgrid.llm.columns import unused
from glyphgrid.session import materialize

#: Slots in a period; documents in a block; the exponent that turns a source's share into its weight.
PERIOD, BLOCK, TEMPERATURE = 1000, 16, 0.7
#: Slots of a period for each kind of sources, at least, and the factor within which small targets are one kind.
SLOTS, GRID = 200, 1.05
#: Rows that one part of a source should have, for numbering.
PART = 50_000
#: Files whose starts are broadcast, some MB.
FILES = 100_000


def kinds_of(counts: DataFrame, temperature: float = TEMPERATURE, targets: dict[str, float] | None = None) -> DataFrame:
    """(source, n, share, kind): a source's target share, and the name of the kind it is scheduled with.

    Without ``targets`` a source's share follows its documents to the power ``temperature``.
    """
    raw = F.pow(F.col("n").cast("double"), F.lit(temperature))
    if targets:
        wanted = counts.sparkSession.createDataFrame(pa.table({"source": pa.array(list(targets), pa.string()), "target": pa.array(list(targets.values()), pa.float64())}))
        counts, raw = counts.join(wanted, "source", "left"), F.coalesce("target", F.lit(0.0))
    total = counts.agg(F.sum(raw)).first()[0] or 1.0
    share = raw / F.lit(float(total))
    step = F.floor(F.log(F.col("share")) / F.lit(math.log(GRID))).cast("string")
    kind = F.when(F.col("share") >= 1 / PERIOD, F.concat(F.lit("="), "source")).when(F.col("share") > 0, F.concat(F.lit("~"), step)).otherwise(F.lit("none"))
    return counts.select("source", "n", share.alias("share")).withColumn("kind", kind)


def kind_weights(kinds: DataFrame, period: int | None = None) -> DataFrame:
    """(kind, members, weight, period): whole numbers of at least 1 that sum to ``period``; largest remainders settle the rounding.

    A period that is asked for grows only if it has less than a slot for each kind.
    """
    each = materialize(kinds.groupBy("kind").agg(F.count("*").alias("members"), F.sum("share").alias("share")), "kinds")  # a bounded number
    found = each.count()
    if period is None or period < found:
        period = max(PERIOD, SLOTS * found)
    all_ = Window.partitionBy()
    # each kind has 1, and shares in the others by weight
    given = each.withColumn("share", F.col("share") / F.greatest(F.sum("share").over(all_), F.lit(1e-300)) * (period - found))
    short = period - found - F.sum(F.floor("share")).over(all_)
    order = F.row_number().over(Window.partitionBy().orderBy(F.desc(F.round(F.col("share") - F.floor("share"), 9)), "kind"))
    ranked = given.withColumn("short", short).withColumn("rank", order)
    return ranked.select("kind", "members", (1 + F.floor("share") + (F.col("rank") <= F.col("short")).cast("long")).alias("weight"), F.lit(period).cast("long").alias("period"))


def source_weights(counts: DataFrame, period: int | None = None, temperature: float = TEMPERATURE, targets: dict[str, float] | None = None) -> DataFrame:
    """(source, n, kind, members, member, weight, period): the weight of a source's kind, and which of its members the source is."""
    kinds = materialize(kinds_of(counts, temperature, targets), "source-kinds")
    turns = kinds.select(F.col("kind").alias("source"), F.col("source").alias("doc_id"), "n", F.xxhash64("source").alias("order"))
    sources = kinds.count()
    member = numbered(turns.withColumnRenamed("n", "has"), max(1, -(-sources // PART))).select(F.col("doc_id").alias("source"), F.col("has").alias("n"), F.col("source").alias("kind"), F.col("n").alias("member"))
    return member.join(kind_weights(kinds, period), "kind").select("source", "n", "kind", "members", "member", "weight", "period")


def slots_of(weights: list[int]) -> tuple[list[int], list[int]]:
    """For each slot of a period its source (a place in ``weights``) and which of its blocks, by earliest deadline."""
    period = sum(weights)
    had, turn, block = [0] * len(weights), [], []
    released: list[tuple] = []
    due: dict[int, list[int]] = {0: list(range(len(weights)))}
    for t in range(period):
        for i in due.pop(t, ()):
            w, n = weights[i], had[i] + 1
            # of equal deadlines, the one whose next window overlaps is the more urgent, then the heavier, then the first
            heapq.heappush(released, (-(-n * period // w), n * period % w == 0, -w, i))
        i = heapq.heappop(released)[-1]
        turn.append(i)
        block.append(had[i])
        had[i] += 1
        if had[i] < weights[i]:
            due.setdefault(max(t + 1, had[i] * period // weights[i]), []).append(i)
    return turn, block


def one_period(weights: DataFrame) -> DataFrame:
    """(kind, j, slot): the slot of each block of a period. Only the kinds and their weights come to the driver."""
    rows = sorted(((r["kind"], int(r["weight"])) for r in weights.select("kind", "weight").distinct().collect()), key=lambda r: (r[0].encode(), r[1]))
    turn, block = (np.array(x, np.int64) for x in slots_of([w for _, w in rows]))
    names = pa.array([s for s, _ in rows], pa.string())
    return weights.sparkSession.createDataFrame(pa.table({"kind": names.take(pa.array(turn)), "j": block, "slot": np.arange(len(turn))}))


def numbered(docs: DataFrame, parts: int) -> DataFrame:
    """Documents numbered within their source in the order of a hash of the id.

    A source may hold a third of all rows, so it is split into ranges of the
    hash, each numbered by itself and shifted by what the ranges before it hold.
    """
    keyed = docs.withColumn("part", F.floor(F.shiftrightunsigned(F.col("order"), 1) / F.lit(2.0**63) * parts).cast("int"))
    sizes = keyed.groupBy("source", "part").agg(F.count("*").alias("m"))
    before = sizes.withColumn("before", F.coalesce(F.sum("m").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("m")
    # unsigned order within a part, as the parts are cut by the unsigned hash
    inside = Window.partitionBy("source", "part").orderBy(F.shiftrightunsigned(F.col("order"), 1), "order", "doc_id")
    ranked = keyed.withColumn("k", F.row_number().over(inside) - 1)
    return ranked.join(before, ["source", "part"]).withColumn("n", F.col("k") + F.col("before")).drop("k", "before", "part")


def mix(docs: DataFrame, period: int | None = None, block: int = BLOCK, temperature: float = TEMPERATURE, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, source, block, release, deadline, slot, place, on_target for every row.

    ``place`` numbers the documents of a slot; (slot, place) is the order of the mix.
    Without ``period`` it follows from the number of kinds of sources.
    """
    order = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"))), F.xxhash64(F.monotonically_increasing_id()))
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), order.alias("order")), "mix-rows")
    counts = materialize(rows.groupBy("source").agg(F.count("*").alias("n")), "source-counts")
    weights = materialize(source_weights(counts, period, temperature, targets), "source-weights")
    plan = materialize(one_period(weights), "mix-period")
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    period_, weight, members = F.col("period"), F.col("weight"), F.col("members")
    # a block of a source is a block of its kind, whose turn in the period the plan has
    turn = lambda j: (j * members + F.col("member"))
    in_plan = lambda df: df.withColumn("j", F.col("turn") % weight).join(plan, ["kind", "j"]).withColumn("slot", F.floor(F.col("turn") / weight) * period_ + F.col("slot"))
    # the first slot without its block: the next one of each source after its last
    dry = in_plan(weights.withColumn("turn", turn(F.ceil(F.col("n") / block)))).agg(F.min("slot")).first()[0]
    placed = numbered(rows, max(1, -(-n // PART))).withColumn("block", F.floor(F.col("n") / block)).withColumn("place", F.col("n") % block)
    slotted = in_plan(placed.drop("n").join(weights.drop("n"), "source").withColumn("turn", turn(F.col("block"))))
    return slotted.select(
        "doc_id",
        "source",
        "block",
        F.floor(F.col("block") * period_ * members / weight).alias("release"),
        F.ceil((F.col("block") + 1) * period_ * members / weight).alias("deadline"),
        "slot",
        "place",
        (F.col("slot") < F.lit(dry)).alias("on_target"),
    )


def in_mixed_order(docs: DataFrame, period: int | None = None, block: int = BLOCK, temperature: float = TEMPERATURE, targets: dict[str, float] | None = None) -> DataFrame:
    """All rows and columns of ``docs``, dealt and sorted so that files, read in order, follow the mix."""
    at, id_ = unused(docs, "at", "id")
    order = mix(docs, period, block, temperature, targets).groupBy(F.col("doc_id").alias(id_)).agg(F.min(F.struct("slot", "place")).alias(at))
    joined = docs.join(order, docs["doc_id"].cast("long").eqNullSafe(order[id_]))
    return joined.repartitionByRange(at).sortWithinPartitions(at).drop(at, id_)


def in_file_order(docs: DataFrame, name: str = "position") -> DataFrame:
    """``docs``, read from the files of :func:`in_mixed_order`, with each row's number in the order of the mix.

    Rows are numbered by the number in the file's name, the name and the place in the
    file, whatever order the scan takes files in. Only the number of rows of each file
    is gathered, and broadcast if it is for at most ``FILES`` files.
    """
    file, row, ahead = unused(docs, "file", "row", "ahead")
    placed = docs.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(row))
    sizes = materialize(placed.groupBy(file).agg(F.count("*").alias("n")), "file-sizes")
    number = F.regexp_extract(file, r"^part-(\d+)", 1).try_cast("long")
    before = Window.orderBy(number, file).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(file, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(ahead))
    starts = F.broadcast(starts) if sizes.count() <= FILES else starts
    return placed.join(starts, file).withColumn(name, F.col(ahead) + F.col(row)).drop(file, row, ahead)
