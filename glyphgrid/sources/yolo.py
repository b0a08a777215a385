"""YOLO detections with confidence and class name, one a line."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphgrid.functions import geometry as G
from glyphgrid.operators.labels import require


def error_of(fields: Column) -> Column:
    """What is wrong with a line's fields; null if nothing is."""
    number = lambda k: F.get(fields, F.lit(k)).try_cast("double")
    bad = lambda k: ~F.coalesce(G.finite(number(k)), F.lit(False))
    category = F.get(fields, F.lit(0))
    return (
        F.when(F.size(fields) < 7, "a detection needs seven fields")
        .when(~category.rlike(r"^\+?\d+$") | category.try_cast("int").isNull(), "the category must be a whole number of at least 0")
        .when(bad(1) | bad(2) | bad(3) | bad(4) | bad(5), "coordinates and confidence must be finite numbers")
        .when((number(3) <= 0) | (number(4) <= 0), "width and height must be positive")
        .when((number(5) < 0) | (number(5) > 1), "the confidence must be in [0, 1]")
    )


def detections(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Lines (page_key, line_no, raw) as regions numbered in their order; blank lines are none."""
    fields = F.array_remove(F.split(F.col("raw"), r"(?U)[\s\x1c-\x1f]+"), "")
    split = lines.withColumn("f", fields).filter(F.size("f") > 0)
    split = split.withColumn("error", error_of(F.col("f")))
    if strict:
        fail = F.raise_error(F.concat(F.lit("page "), "page_key", F.lit(", line "), F.col("line_no").cast("string"), F.lit(": "), "error"))
        split = split.withColumn("error", F.when(F.col("error").isNotNull(), fail.cast("string")))
    number = lambda k: F.get("f", F.lit(k)).try_cast("double")
    order = Window.partitionBy("page_key").orderBy("line_no")
    name = F.array_join(F.slice("f", F.lit(7), F.greatest(F.size("f") - 6, F.lit(0))), " ")
    return split.filter("error IS NULL" if strict else "true").select(
        "page_key", (F.row_number().over(order) - 1).cast("int").alias("region_id"), name.alias("label"), F.get("f", F.lit(0)).try_cast("int").alias("category_id"),
        G.center_box(number(1), number(2), number(3), number(4)).alias("bbox"), number(5).alias("confidence"), "error",
    )


def lines_of(files: DataFrame) -> DataFrame:
    """(page_key, line_no, raw) of whole files (page_key, content)."""
    return files.select("page_key", F.posexplode(F.split("content", r"\r\n|\r|\n")).alias("line_no", "raw"))


def category_conflicts(regions: DataFrame, by_page: bool = False) -> DataFrame:
    """Categories with more than one name, and names with more than one category."""
    keys = ["page_key"] if by_page else []
    pairs = regions.filter("category_id IS NOT NULL").select(*keys, "category_id", "label").distinct()
    ids = pairs.groupBy(*keys, "category_id").agg(F.count("*").alias("n")).filter("n > 1").select(*keys, F.lit("category").alias("kind"), F.col("category_id").cast("string").alias("value"), "n")
    names = pairs.groupBy(*keys, "label").agg(F.count("*").alias("n")).filter("n > 1").select(*keys, F.lit("label").alias("kind"), F.col("label").alias("value"), "n")
    return ids.unionByName(names)


@dataclass(frozen=True)
class Group:
    """Labels of which only one may stand in a place."""

    labels: frozenset[str]
    minimum: float

    def __post_init__(self):
        require(len(self.labels) >= 2 and all(x.strip() for x in self.labels), "a group needs two labels, none blank")
        require(0 < self.minimum <= 1, "the minimum coverage must be in (0, 1]")


def deduplicated(regions: DataFrame, groups: Sequence[Group]) -> DataFrame:
    """Regions without those that a more confident one of another label of their group covers.

    Taken by confidence, then number: a region goes if one that stayed covers
    it, over the larger of both, at least to the group's minimum.
    """
    labels = [x for g in groups for x in g.labels]
    require(len(set(labels)) == len(labels), "a label may be in one group only")
    if not groups:
        return regions
    group = F.lit(None).cast("int")
    for k, g in enumerate(groups):
        group = F.when(F.col("label").isin(sorted(g.labels)), F.lit(k)).otherwise(group)
    minimum = F.element_at(F.array(*(F.lit(float(g.minimum)) for g in groups)), F.col("grp") + 1)
    grouped = regions.withColumn("grp", group)
    own = F.struct((-F.col("confidence")).alias("order"), "region_id", "label", "bbox")
    lists = grouped.filter("grp IS NOT NULL").withColumn("least", minimum).groupBy("page_key", "grp").agg(F.array_sort(F.collect_list(own)).alias("all"), F.first("least").alias("least"))
    free = lambda kept, r: F.forall(kept, lambda k: (k["label"] == r["label"]) | (G.mutual_coverage(k["bbox"], r["bbox"]) < F.col("least")))
    kept = F.aggregate("all", F.slice("all", F.lit(1), F.lit(0)), lambda kept, r: F.when(free(kept, r), F.array_append(kept, r)).otherwise(kept))
    gone = lists.select("page_key", F.explode(F.array_except("all", kept)).alias("r")).select("page_key", "r.region_id")
    return regions.join(gone, ["page_key", "region_id"], "left_anti")
