"""Aligned pages as Label Studio predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphgrid.functions import geometry as G
from glyphgrid.operators.labels import export_label, require
from glyphgrid.sinks.json_pages import quoted


def results(aligned: DataFrame, pages: DataFrame, mode: str = "geometry", text_source: str = "json", geometry_source: str = "input") -> DataFrame:
    """(page_key, region_id, label, text, x, y, width, height, confidence, alignment_score, score): boxes in percent of the page.

    Regions without text or geometry are left out; a page or box without
    positive finite size is an error.
    """
    text = F.col("input_text") if mode == "text" and text_source == "json" else F.col("alto_text")
    use_input = mode == "geometry" and geometry_source == "input"
    box = G.bounds(F.col("bbox"), F.col("polygon")) if use_input else G.bounds(F.col("alto_bbox"), F.col("alto_polygon"))
    confidence = F.col("confidence") if "confidence" in aligned.columns else F.lit(None).cast("double")
    chosen = aligned.select("page_key", "region_id", export_label().alias("label"), text.alias("text"), box.alias("b"), confidence.alias("confidence"), "alignment_score").filter("text IS NOT NULL AND b IS NOT NULL")
    sized = chosen.join(pages.select("page_key", "alto_width", "alto_height"), "page_key", "left")
    positive = lambda c: F.coalesce(G.finite(c) & (c > 0), F.lit(False))
    fine = positive(F.col("alto_width")) & positive(F.col("alto_height")) & G.finite(F.col("b.x")) & G.finite(F.col("b.y")) & positive(F.col("b.width")) & positive(F.col("b.height"))
    fail = F.raise_error(F.concat(F.lit("sizes must be positive and finite on page "), "page_key")).cast("boolean")
    percent = G.to_percent(F.col("b"), F.col("alto_width"), F.col("alto_height"))
    return sized.filter(F.when(fine, F.lit(True)).otherwise(fail)).withColumn("p", percent).select("page_key", "region_id", "label", "text", "p.x", "p.y", "p.width", "p.height", "confidence", "alignment_score", F.least("confidence", "alignment_score").alias("score"))


def documents(found: DataFrame, pages: DataFrame, image_prefix: str) -> DataFrame:
    """(page_key, json): one task a page, with the least score of its results."""
    require(bool(image_prefix.strip()), "an image prefix is needed")
    member = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f',"{name}":'), c.cast("string"))).otherwise(F.lit(""))
    number = lambda n: F.concat(F.lit(f'"{n}":'), G.clean_number(F.col(n)))
    value = F.concat(F.lit("{"), F.concat_ws(",", *map(number, ("x", "y", "width", "height"))), F.lit(',"rectanglelabels":['), quoted(F.col("label")), F.lit("]}"))
    meta = F.concat(F.lit('{"text":['), quoted(F.col("text")), F.lit("]"), member("input_geometry_confidence", F.col("confidence")), member("alignment_score", F.col("alignment_score")), F.lit("}"))
    entry = F.concat(F.lit('{"from_name":"label","to_name":"image","type":"rectanglelabels","value":'), value, F.lit(',"meta":'), meta, member("score", F.col("score")), F.lit("}"))
    lists = found.withColumn("entry", entry).groupBy("page_key").agg(F.array_sort(F.collect_list(F.struct("region_id", "entry"))).alias("r"), F.min("score").alias("score"))
    joined = pages.select("page_key").join(lists, "page_key", "left")
    image = quoted(F.concat(F.lit(image_prefix.rstrip("/") + "/"), "page_key", F.lit(".jpg")))
    entries = F.coalesce(F.array_join(F.transform("r", lambda x: x["entry"]), ","), F.lit(""))
    return joined.select("page_key", F.concat(F.lit('{"data":{"image":'), image, F.lit('},"predictions":[{"result":['), entries, F.lit("]"), member("score", F.col("score")), F.lit("}]}")).alias("json"))
