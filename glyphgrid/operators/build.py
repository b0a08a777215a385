"""Text and geometry of the words matched to a region."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphgrid.functions import geometry as G
from glyphgrid.operators.orthogonal import orthogonal_polygon

WORD = ("word_index", "text", "x", "y", "width", "height", "line_index", "block_index")


def joined_text(words: Column) -> Column:
    """The words' texts joined by spaces; null without words."""
    return F.when(F.size(words) > 0, F.array_join(F.transform(words, lambda w: w["text"]), " "))


def union_box(words: Column) -> Column:
    left, top = F.array_min(F.transform(words, lambda w: w["x"])), F.array_min(F.transform(words, lambda w: w["y"]))
    right, bottom = F.array_max(F.transform(words, lambda w: w["x"] + w["width"])), F.array_max(F.transform(words, lambda w: w["y"] + w["height"]))
    return F.when(F.size(words) > 0, G.box(left, top, right - left, bottom - top))


def matched_words(assigned: DataFrame, words: DataFrame) -> DataFrame:
    """(page_key, region_id, words, alignment_score): the assigned words of each region in document order.

    Overlaps that carry the words' columns need no join with the words.
    """
    scores = ("word_coverage", "input_geometry_coverage", "overlap_score")
    joined = assigned if set(WORD) <= set(assigned.columns) else assigned.select("page_key", "region_id", "word_index", *scores).join(words.select("page_key", *WORD), ["page_key", "word_index"])
    return joined.groupBy("page_key", "region_id").agg(
        F.array_sort(F.collect_list(F.struct(*WORD, *scores))).alias("words"),
        F.avg("overlap_score").alias("alignment_score"),
    )


def with_alto(df: DataFrame, geometry_format: str = "bbox", text: Callable[[Column], Column] = joined_text, outline: Callable[[Column], Column] = orthogonal_polygon, box: Callable[[Column], Column] = union_box) -> DataFrame:
    """alto_text and alto_bbox or alto_polygon from the column ``words``; ``text``, ``outline`` and ``box`` build them."""
    if geometry_format not in ("bbox", "polygon"):
        raise ValueError(f"unknown geometry format {geometry_format!r}")
    none_box, none_ring = F.lit(None).cast("struct<x:double,y:double,width:double,height:double>"), F.lit(None).cast("array<struct<x:double,y:double>>")
    polygon = outline(F.col("words")) if geometry_format == "polygon" else none_ring
    return df.withColumn("alto_text", text(F.col("words"))).withColumn("alto_bbox", box(F.col("words")) if geometry_format == "bbox" else none_box).withColumn("alto_polygon", polygon)


def line_envelopes(matched: DataFrame) -> DataFrame:
    """(page_key, region_id, block_index, line_index, x, y, x_max, y_max) of each line's words; words without a line stand alone."""
    each = matched.select("page_key", "region_id", F.explode("words").alias("w")).select("page_key", "region_id", "w.*")
    alone = F.when(F.col("line_index").isNull(), F.col("word_index"))
    return (
        each.withColumn("alone", alone)
        .groupBy("page_key", "region_id", "block_index", "line_index", "alone")
        .agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("x_max"), F.max(F.col("y") + F.col("height")).alias("y_max"))
        .drop("alone")
    )
