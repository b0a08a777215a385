"""The plan of a rendering: what is drawn where on each page's image, in which order and colour."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphgrid.functions import geometry as G
from glyphgrid.sinks.json_pages import chosen_geometry

COLOURS = 6


def render_plan(aligned: DataFrame, pages: DataFrame, mode: str = "geometry", fmt: str = "bbox", text_source: str = "json", geometry_source: str = "input") -> DataFrame:
    """(page_key, ordinal, region_id, colour, label, left, top, right, bottom, points).

    ``pages``: page_key, alto_width, alto_height, image_width, image_height.
    Regions without geometry are not drawn; the order is from the top, then the left.
    """
    text = F.col("input_text") if mode == "text" and text_source == "json" else F.col("alto_text")
    box, ring = chosen_geometry("alto" if mode == "text" else geometry_source, fmt)
    drawn = aligned.select("page_key", "region_id", text.alias("text"), "alignment_score", G.bounds(box, ring).alias("b"), ring.alias("ring")).filter("b IS NOT NULL")
    order = Window.partitionBy("page_key").orderBy("b.y", "b.x", "region_id")
    label = F.format_string("%s [%s]", F.coalesce("text", F.lit("null")), F.coalesce(F.format_string("%.2f", "alignment_score"), F.lit("null")))
    across, down = F.col("image_width") / F.col("alto_width"), F.col("image_height") / F.col("alto_height")
    place = lambda v, s, most: G.scaled(v, s, F.col(most))
    numbered = drawn.withColumn("ordinal", (F.row_number().over(order) - 1).cast("int")).join(pages, "page_key")
    return numbered.select(
        "page_key", "ordinal", "region_id", (F.col("ordinal") % COLOURS).alias("colour"), label.alias("label"),
        place(F.col("b.x"), across, "image_width").alias("left"), place(F.col("b.y"), down, "image_height").alias("top"),
        place(G.x_max(F.col("b")), across, "image_width").alias("right"), place(G.y_max(F.col("b")), down, "image_height").alias("bottom"),
        F.transform("ring", lambda p: F.struct(place(p["x"], across, "image_width").alias("x"), place(p["y"], down, "image_height").alias("y"))).alias("points"),
    )
