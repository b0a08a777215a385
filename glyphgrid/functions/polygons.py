"""What polygons share with boxes, and their validity, as column expressions.

A polygon is a closed ring of points; inside, rings are open.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once a row however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def before(ring: Column, k: Column) -> Column:
    """The point before the k-th of an open ring; before the first stands the last."""
    return F.get(ring, F.when(k == 0, F.size(ring) - 1).otherwise(k - 1))


def opened(polygon: Column) -> Column:
    """The ring of a polygon without a point that repeats the one before it, the first included."""
    return once(polygon, lambda p: F.filter(p, lambda q, k: q != before(p, k)))


def under(a: Column, b: Column, box: Column) -> Column:
    """Signed area between a side and the top of a box, of what lies over and in the box: across the box's width only, and no deeper than its height."""
    left, top, right, bottom = box["x"], box["y"], box["x"] + box["width"], box["y"] + box["height"]
    within = lambda v, low, high: F.least(F.greatest(v, low), high)
    slope = (b["y"] - a["y"]) / (b["x"] - a["x"])
    # the part of the side across the box
    part = F.struct(within(a["x"], left, right).alias("x1"), within(b["x"], left, right).alias("x2"))
    cut = once(part, lambda s: F.struct(s["x1"], s["x2"], (a["y"] + (s["x1"] - a["x"]) * slope).alias("y1"), (a["y"] + (s["x2"] - a["x"]) * slope).alias("y2")))

    def depth(s: Column) -> Column:
        y1, y2 = s["y1"], s["y2"]
        inner = once(F.struct(within(y1, top, bottom).alias("u"), within(y2, top, bottom).alias("v")), lambda c: (c["v"] - c["u"]) / (y2 - y1) * ((c["u"] + c["v"]) / 2 - top))
        below = (F.greatest(y2, bottom) - F.greatest(y1, bottom)) / (y2 - y1) * (bottom - top)
        return (s["x2"] - s["x1"]) * F.when(y1 == y2, within(y1, top, bottom) - top).otherwise(inner + below)

    return F.when(a["x"] == b["x"], F.lit(0.0)).otherwise(once(cut, depth))


def shared_area(ring: Column, box: Column) -> Column:
    """Area that an open ring, whose sides do not cross, shares with a box: the sum of what its sides have above them in the box."""
    each = lambda r: F.transform(r, lambda p, k: once(before(r, k), lambda q: under(q, p, box)))
    return F.abs(F.aggregate(once(ring, each), F.lit(0.0), lambda s, x: s + x))


def ring_area(ring: Column) -> Column:
    """Half the absolute shoelace sum of an open ring."""
    cross = lambda r: F.transform(r, lambda p, k: before(r, k)["x"] * p["y"] - p["x"] * before(r, k)["y"])
    return F.abs(F.aggregate(once(ring, cross), F.lit(0.0), lambda s, x: s + x)) / 2


def crossing(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Do the segments ab and cd meet."""
    turn = lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])
    between = lambda p, q, r, n: (F.least(p[n], q[n]) <= r[n]) & (r[n] <= F.greatest(p[n], q[n]))
    on = lambda p, q, r: (turn(p, q, r) == 0) & between(p, q, r, "x") & between(p, q, r, "y")
    apart = lambda p, q, r, s: F.signum(turn(p, q, r)) * F.signum(turn(p, q, s)) < 0
    return (apart(a, b, c, d) & apart(c, d, a, b)) | on(a, b, c) | on(a, b, d) | on(c, d, a) | on(c, d, b)


def turns_back(a: Column, corner: Column, b: Column) -> Column:
    """Does a ring go back on itself at a corner."""
    dx, dy, ex, ey = a["x"] - corner["x"], a["y"] - corner["y"], b["x"] - corner["x"], b["y"] - corner["y"]
    return (dx * ey == dy * ex) & (dx * ex + dy * ey > 0)


def is_valid(polygon: Column) -> Column:
    """Of positive area, and no two sides meet but neighbours at their corner; null for a null polygon."""

    def checked(ring: Column) -> Column:
        n = F.size(ring)
        at = lambda k: F.get(ring, F.pmod(k, n))

        def clash(i: Column, j: Column) -> Column:
            follows, closes = j == i + 1, (i == 0) & (j == n - 1)
            return F.when(follows, turns_back(at(i), at(j), at(j + 1))).when(closes, turns_back(at(j), at(i), at(i + 1))).otherwise(crossing(at(i), at(i + 1), at(j), at(j + 1)))

        numbers = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
        meets = F.exists(numbers, lambda i: F.exists(F.filter(numbers, lambda j: j > i), lambda j: clash(i, j)))
        return (n >= 3) & (ring_area(ring) > 0) & ~meets

    return F.when(polygon.isNotNull(), F.coalesce(once(opened(polygon), checked), F.lit(False)))


def shared_areas(polygons: pa.ListArray, x: np.ndarray, y: np.ndarray, width: np.ndarray, height: np.ndarray) -> np.ndarray:
    """:func:`shared_area` of many rings, open or closed, with a box each; the sides of all rings at once."""
    sizes = pc.fill_null(pc.list_value_length(polygons), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    points = polygons.flatten()
    px, py = (pc.struct_field(points, n).to_numpy(zero_copy_only=False) for n in ("x", "y"))
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(sizes)), sizes)
    last = np.arange(len(of)) - 1
    first = (ends - sizes)[sizes > 0]
    last[first] = ends[sizes > 0] - 1
    left, top = x[of], y[of]
    right, bottom = left + width[of], top + height[of]
    within = lambda v, low, high: np.minimum(np.maximum(v, low), high)
    ax, ay = px[last], py[last]
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = (py - ay) / (px - ax)
        x1, x2 = within(ax, left, right), within(px, left, right)
        y1, y2 = ay + (x1 - ax) * slope, ay + (x2 - ax) * slope
        u, v = within(y1, top, bottom), within(y2, top, bottom)
        inner = (v - u) / (y2 - y1) * ((u + v) / 2 - top)
        below = (np.maximum(y2, bottom) - np.maximum(y1, bottom)) / (y2 - y1) * (bottom - top)
        side = np.where(ax == px, 0.0, (x2 - x1) * np.where(y1 == y2, u - top, inner + below))
    return np.abs(np.bincount(of, side, len(sizes)))


@F.arrow_udf(DoubleType())
def areas_shared(polygon: pa.Array, x: pa.Array, y: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
    found = shared_areas(polygon, *(c.to_numpy(zero_copy_only=False) for c in (x, y, width, height)))
    return pa.array(found, mask=polygon.is_null().to_numpy(zero_copy_only=False))


#: So declared that filters on the area do not work it out again.
areas_shared = areas_shared.asNondeterministic()


def polygon_box_area(polygon: Column, box: Sequence[Column], valid: Column) -> Column:
    """Area that a polygon shares with a box (x, y, width, height); null polygons give null, one that is not ``valid`` is an error."""
    wrong = F.raise_error(F.concat(F.lit("polygon is not valid: "), F.to_json(F.slice(polygon, 1, 4)))).cast("double")
    area = areas_shared(polygon, *box)
    return F.when(polygon.isNotNull(), F.when(valid, area).otherwise(wrong))
