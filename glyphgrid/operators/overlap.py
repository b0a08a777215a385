"""Spatial join of regions with the words they cover."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphgrid.functions import geometry as G
from glyphgrid.functions.polygons import is_valid, polygon_box_area
from glyphgrid.operators.labels import require

BIDIRECTIONAL, WORD_COVERAGE = "bidirectional-containment", "word-coverage"
GREATEST, ALL = "greatest-coverage", "all-over-threshold"
EPSILON = 1e-12
#: Height of the rows into which a page is cut for the join.
ROW_HEIGHT = 64.0
BOX = ("x", "y", "width", "height")


def overlaps(regions: DataFrame, words: DataFrame, minimum: float = 0.65, strategy: str = BIDIRECTIONAL, row_height: float = ROW_HEIGHT, polygons: bool = True, carried: Sequence[str] = ()) -> DataFrame:
    """(page_key, region_id, word_index, word_coverage, input_geometry_coverage, overlap_score), and the ``carried`` columns of the words.

    A page is cut into rows of fixed height; regions and words meet in the rows
    they touch, once, in the first row both touch. So a page with very many
    words or regions is many keys, and no word is compared with the regions of
    another part of the page. Polygons are first joined by their bounds, and only
    what is left is clipped.
    """
    require(0 <= minimum <= 1, "minimum overlap coverage must be in [0, 1]")
    require(strategy in (BIDIRECTIONAL, WORD_COVERAGE), f"unknown overlap strategy {strategy!r}")
    bbox, polygon = F.col("bbox"), F.col("polygon") if polygons else F.lit(None).cast("array<struct<x:double,y:double>>")
    kept = ("bbox", "polygon") if polygons else ()
    r = regions.select("page_key", "region_id", *kept, *([is_valid(polygon).alias("valid")] if polygons else []), G.bounds(bbox, polygon).alias("rb"), G.area(bbox, polygon).alias("region_area")).filter("region_area > 0")
    # each number of a word goes to the join once; its box is made of them there
    sides = tuple(n for n in BOX if n not in carried)
    w = words.select("page_key", "word_index", *carried, *sides).filter("width > 0 AND height > 0")
    rows = lambda y, bottom: F.sequence(F.floor(y / row_height), F.floor(bottom / row_height))
    r = r.withColumn("row", F.explode(rows(F.col("rb.y"), G.y_max(F.col("rb")))))
    w = w.withColumn("row", F.explode(rows(F.col("y"), F.col("y") + F.col("height"))))
    first = F.floor(F.greatest("rb.y", "y") / row_height)
    wb = G.box(*(F.col(n) for n in BOX))
    meet = G.intersection_area(F.col("rb"), wb)
    # a part's regions are held and its words go by, so that words, of which there are many, are not sorted
    joined = r.hint("shuffle_hash").join(w, ["page_key", "row"]).filter((F.col("row") == first) & (meet > 0)).withColumn("meet", meet)
    if polygons:
        exact = F.when(F.col("bbox").isNull(), polygon_box_area(F.col("polygon"), [F.col(n) for n in BOX], F.col("valid"))).otherwise(F.col("meet"))
        joined = joined.withColumn("meet", exact).filter("meet > 0")
    of_word = G.bounded_ratio(F.col("meet"), F.col("width") * F.col("height"))
    of_region = G.bounded_ratio(F.col("meet"), F.col("region_area"))
    score = F.col("word_coverage") if strategy == WORD_COVERAGE else F.greatest("word_coverage", "input_geometry_coverage")
    return (
        joined.select("page_key", "region_id", "word_index", *carried, of_word.alias("word_coverage"), of_region.alias("input_geometry_coverage"))
        .withColumn("overlap_score", score)
        .filter(F.col("overlap_score") + EPSILON >= minimum)
    )


def assigned(found: DataFrame, strategy: str = GREATEST) -> DataFrame:
    """Overlaps that stay: all of them, or for each word the one it is covered by best (ties: the smaller region)."""
    require(strategy in (GREATEST, ALL), f"unknown word assignment strategy {strategy!r}")
    if strategy == ALL:
        return found
    best = Window.partitionBy("page_key", "word_index").orderBy(F.desc("overlap_score"), F.desc("word_coverage"), F.desc("input_geometry_coverage"), "region_id")
    return found.withColumn("rank", F.row_number().over(best)).filter("rank = 1").drop("rank")
