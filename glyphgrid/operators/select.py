"""Selection of candidates, and what is ambiguous or in conflict."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphgrid.operators.choice import best_of
from glyphgrid.operators.labels import require
from glyphgrid.session import discard, materialize, page_parts, slices

OPTIMAL, FEASIBLE = "optimal", "feasible"
FIELDS = ("candidate_id", "region_id", "start_word", "end_word", "quality_chars", "exact")
#: How often labels pass along words and regions before it is looked whether they still change.
PASSES = 4


def parts(candidates: DataFrame) -> DataFrame:
    """(page_key, part, alone and the six numbers that count) of every candidate: candidates that share words or regions are one part.

    Spans that overlap are one run of words; the smallest label then passes from run to region and
    back until it stays. ``alone`` says that the part has one region only.
    """
    slim = candidates.select("page_key", *(F.col(f).cast("int").alias(f) for f in FIELDS)).repartition("page_key")
    earlier = Window.partitionBy("page_key").orderBy("start_word", "end_word", "candidate_id")
    reach = F.max("end_word").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    runs = slim.withColumn("fresh", (F.col("start_word") > F.coalesce(reach, F.lit(-1))).cast("int")).withColumn("run", F.sum("fresh").over(earlier)).drop("fresh")
    now, moved = runs.withColumn("part", F.col("run").cast("int")), 1
    by_region, by_run = Window.partitionBy("page_key", "region_id"), Window.partitionBy("page_key", "run")
    while moved:
        for _ in range(PASSES):
            now = now.withColumn("before", F.col("part")).withColumn("part", F.min("part").over(by_region)).withColumn("part", F.min("part").over(by_run))
        last, now = now, materialize(now, "parts")
        moved = now.filter("part <> before").limit(1).count()
        discard(last)
        now = now.repartition("page_key") if moved else now
    whole = Window.partitionBy("page_key", "part")
    alone = F.min("region_id").over(whole) == F.max("region_id").over(whole)
    return now.withColumn("alone", alone).select("page_key", "part", "alone", *FIELDS)


def choices(candidates: DataFrame, seconds: float | None = None, require_optimal: bool = True) -> DataFrame:
    """(page_key, part, candidate_id, status): the best consistent candidates of each part, and whether they are known to be the best.

    The goals are sums, so parts are solved alone, each a row of its own with at
    most ``seconds`` of search. A part that is not settled by then is an error, or
    with ``require_optimal`` false gives the best choice found.
    """
    require(seconds is None or seconds > 0, "the time limit must be positive")
    schema = pa.schema([("page_key", pa.string()), ("part", pa.int32()), ("candidate_id", pa.int32()), ("status", pa.string())])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: list[tuple] = []
            for page, part, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, optimal = best_of([tuple(map(int, s.values())) for s in spans], seconds)
                if require_optimal and not optimal:
                    raise RuntimeError(f"page {page}: no choice was shown to be the best in {seconds} s")
                rows += [(page, part, i, OPTIMAL if optimal else FEASIBLE) for i in ids]
            columns = zip(*rows, strict=True) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    found = parts(candidates)
    first = Window.partitionBy("page_key", "part").orderBy(F.desc("quality_chars"), F.desc("exact"), "start_word", "candidate_id")
    single = found.filter("alone").withColumn("rank", F.row_number().over(first)).filter("rank = 1").select("page_key", "part", "candidate_id", F.lit(OPTIMAL).alias("status"))
    # a part is few bytes but much work: dealt to a number given outright, or Spark folds its parts into a few tasks
    contested = found.filter("NOT alone").repartition(page_parts(candidates.sparkSession), "page_key", "part").groupBy("page_key", "part").agg(F.collect_list(F.struct(*FIELDS)).alias("spans"))
    solved = contested.mapInArrow(solve, "page_key string, part int, candidate_id int, status string")
    return single.unionByName(solved)


def selected(candidates: DataFrame, seconds: float | None = None, require_optimal: bool = True) -> DataFrame:
    """The globally best consistent candidates of each page."""
    return candidates.join(choices(candidates, seconds, require_optimal), ["page_key", "candidate_id"], "left_semi")


def passed_through(candidates: DataFrame) -> DataFrame:
    return candidates


def last_of_region(candidates: DataFrame) -> DataFrame:
    """One candidate a region: the last in candidate order."""
    last = Window.partitionBy("page_key", "region_id").orderBy(F.desc("candidate_id"))
    return candidates.withColumn("rank", F.row_number().over(last)).filter("rank = 1").drop("rank")


def ambiguous(candidates: DataFrame) -> DataFrame:
    """(page_key, region_id, spans): regions whose best candidates are of more than one span."""
    best = Window.partitionBy("page_key", "region_id").orderBy(F.desc("quality_chars"), F.desc("exact"), F.desc("similarity_int"))
    tops = candidates.withColumn("rank", F.rank().over(best)).filter("rank = 1")
    return tops.groupBy("page_key", "region_id").agg(F.countDistinct("start_word", "end_word").alias("spans")).filter("spans > 1")


def conflicted(candidates: DataFrame, chosen: DataFrame) -> DataFrame:
    """(page_key, region_id): regions without a choice, all of whose candidates touch chosen words."""
    each = lambda df: df.select("page_key", "region_id", "candidate_id", F.explode(F.sequence("start_word", "end_word")).alias("word"))
    taken = each(chosen).select("page_key", "word").distinct().withColumn("taken", F.lit(True))
    open_ = candidates.join(chosen.select("page_key", "region_id").distinct(), ["page_key", "region_id"], "left_anti")
    touched = each(open_).join(taken, ["page_key", "word"], "left").groupBy("page_key", "region_id", "candidate_id").agg(F.max(F.coalesce("taken", F.lit(False))).alias("hit"))
    return touched.groupBy("page_key", "region_id").agg(F.min("hit").alias("all_hit")).filter("all_hit").select("page_key", "region_id")
