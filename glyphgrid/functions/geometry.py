"""Boxes, polygons and their measures as column expressions.

A box is a struct (x, y, width, height), a polygon a closed ring of points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphgrid.schemas import BOX, POINTS

#: What makes an input geometry suspicious (fixed limits).
LEAST_SIDE, LEAST_AREA = 5.0, 100.0
#: How near to a whole number a coordinate is written as one.
WHOLE = 1e-9


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (width, "width"), (height, "height"))))


def x_max(b: Column) -> Column:
    return b["x"] + b["width"]


def y_max(b: Column) -> Column:
    return b["y"] + b["height"]


def ring(*points: tuple[Column, Column]) -> Column:
    return F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in points))


def box_polygon(b: Column) -> Column:
    """The closed ring of a box, clockwise from the top left."""
    left, top, right, bottom = b["x"], b["y"], x_max(b), y_max(b)
    return F.when(b.isNull(), F.lit(None).cast(POINTS)).otherwise(ring((left, top), (right, top), (right, bottom), (left, bottom), (left, top)))


def polygon_bounds(p: Column) -> Column:
    xs, ys = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
    found = box(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))
    return F.when(p.isNull(), F.lit(None).cast(BOX)).otherwise(found)


def bounds(bbox: Column, polygon: Column) -> Column:
    """The box of a geometry, whichever of its two columns holds it."""
    return F.when(bbox.isNotNull(), bbox).otherwise(polygon_bounds(polygon))


def as_polygon(bbox: Column, polygon: Column) -> Column:
    return F.when(polygon.isNotNull(), polygon).otherwise(box_polygon(bbox))


def polygon_area(p: Column) -> Column:
    """Half the absolute shoelace sum."""
    cross = F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, x: s + x)) / 2


def area(bbox: Column, polygon: Column) -> Column:
    return F.when(bbox.isNotNull(), F.abs(bbox["width"] * bbox["height"])).otherwise(polygon_area(polygon))


def intersection_area(a: Column, b: Column) -> Column:
    across = F.least(x_max(a), x_max(b)) - F.greatest(a["x"], b["x"])
    down = F.least(y_max(a), y_max(b)) - F.greatest(a["y"], b["y"])
    return F.greatest(across, F.lit(0.0)) * F.greatest(down, F.lit(0.0))


def bounded_ratio(part: Column, whole: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), part / whole))


def mutual_coverage(a: Column, b: Column) -> Column:
    """Intersection over the larger of two boxes."""
    return intersection_area(a, b) / F.greatest(a["width"] * a["height"], b["width"] * b["height"])


def center_box(center_x: Column, center_y: Column, width: Column, height: Column) -> Column:
    return box(center_x - width / 2, center_y - height / 2, width, height)


def from_percent(b: Column, width: Column, height: Column) -> Column:
    return box(b["x"] / 100 * width, b["y"] / 100 * height, b["width"] / 100 * width, b["height"] / 100 * height)


def to_percent(b: Column, width: Column, height: Column) -> Column:
    return box(b["x"] / width * 100, b["y"] / height * 100, b["width"] / width * 100, b["height"] / height * 100)


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def clean_number(value: Column) -> Column:
    """A number as JSON text: whole numbers without a point."""
    near = F.abs(value - F.rint(value)) <= WHOLE
    return F.when(near, F.rint(value).cast("long").cast("string")).otherwise(value.cast("string"))


def quality_issues(bbox: Column, polygon: Column) -> Column:
    """Why an input geometry looks wrong; empty if it does not."""
    b = bounds(bbox, polygon)
    values = F.when(bbox.isNotNull(), F.array(bbox["x"], bbox["y"], bbox["width"], bbox["height"])).otherwise(F.flatten(F.transform(polygon, lambda p: F.array(p["x"], p["y"]))))
    places = F.when(bbox.isNotNull(), F.array(bbox["x"], bbox["y"])).otherwise(values)
    found = F.array_compact(
        F.array(
            F.when(F.exists(values, lambda v: ~finite(v)), F.lit("non-finite coordinate")),
            F.when(F.exists(places, lambda v: v < 0), F.lit("negative coordinate")),
            F.when(b["width"] < LEAST_SIDE, F.lit("width below 5")),
            F.when(b["height"] < LEAST_SIDE, F.lit("height below 5")),
            F.when(area(bbox, polygon) < LEAST_AREA, F.lit("area below 100")),
        )
    )
    return F.when(bbox.isNull() & polygon.isNull(), F.array().cast("array<string>")).otherwise(found)


def scaled(value: Column, scale: Column, most: Column) -> Column:
    """A coordinate on an image: scaled, rounded half to even, within the image."""
    return F.least(F.greatest(F.rint(value * scale), F.lit(0.0)), (most - 1).cast("double")).cast("int")
