"""Overlap, assignment, outlines and measures against literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from glyphgrid.functions import geometry as G
from glyphgrid.functions.polygons import is_valid, opened, shared_area
from glyphgrid.operators.orthogonal import orthogonal_polygon
from glyphgrid.operators.overlap import ALL, WORD_COVERAGE, assigned, overlaps
from glyphgrid.plans.aligners import GeometryAlignment

BOX = "struct<x:double,y:double,width:double,height:double>"
POINTS = "array<struct<x:double,y:double>>"


def regions(spark, *boxes):
    return spark.createDataFrame([("p", k, f"r{k}", b, None) for k, b in enumerate(boxes)], f"page_key string, region_id int, label string, bbox {BOX}, polygon {POINTS}")


def words(spark, *boxes, lines=None):
    rows = [("p", k, f"W{k}", *map(float, b), None if lines is None else lines[k], 0) for k, b in enumerate(boxes)]
    return spark.createDataFrame(rows, "page_key string, word_index int, text string, x double, y double, width double, height double, line_index int, block_index int")


def found(df):
    return sorted((r.region_id, r.word_index, round(r.overlap_score, 6)) for r in df.collect())


def test_threshold_is_inclusive(spark):
    w = words(spark, (0, 0, 10, 10))
    assert found(overlaps(regions(spark, (0.0, 0.0, 6.5, 10.0)), w, 0.65, WORD_COVERAGE)) == [(0, 0, 0.65)]
    assert found(overlaps(regions(spark, (0.0, 0.0, 6.49, 10.0)), w, 0.65, WORD_COVERAGE)) == []


def test_containment_either_way(spark):
    r = overlaps(regions(spark, (2.0, 2.0, 4.0, 4.0)), words(spark, (0, 0, 10, 10))).first()
    assert (round(r.word_coverage, 6), r.input_geometry_coverage, r.overlap_score) == (0.16, 1.0, 1.0)


def test_edges_and_empty_boxes_do_not_overlap(spark):
    assert found(overlaps(regions(spark, (10.0, 0.0, 5.0, 5.0)), words(spark, (0, 0, 10, 10), (11, 1, 0, 3)), 0.0)) == []


def test_tall_boxes_meet_once_over_row_borders(spark):
    assert found(overlaps(regions(spark, (0.0, 10.0, 50.0, 500.0)), words(spark, (0, 0, 50, 600), (5, 300, 10, 10)), 0.1)) == [(0, 0, 1.0), (0, 1, 1.0)]


def test_negative_coordinates(spark):
    assert found(overlaps(regions(spark, (-20.0, -100.0, 40.0, 90.0)), words(spark, (-10, -50, 10, 10)))) == [(0, 0, 1.0)]


@pytest.mark.parametrize("bad", [-0.1, 1.1])
def test_threshold_range(spark, bad):
    with pytest.raises(ValueError):
        overlaps(regions(spark), words(spark), bad)


def test_outer_and_middle(spark):
    r = regions(spark, (0.0, 0.0, 30.0, 8.0), (10.0, 0.0, 10.0, 10.0))
    w = words(spark, (0, 0, 10, 10), (10, 0, 10, 10), (20, 0, 10, 10))
    out = {x.region_id: (x.alto_text, round(x.alignment_score, 6)) for x in GeometryAlignment().align(r, w).collect()}
    assert out == {0: ("W0 W2", 0.8), 1: ("W1", 1.0)}
    assert found(assigned(overlaps(r, w), ALL)) == [(0, 0, 0.8), (0, 1, 0.8), (0, 2, 0.8), (1, 1, 1.0)]


def test_ties_go_to_the_smaller_region(spark):
    out = assigned(overlaps(regions(spark, (0.0, 0.0, 10.0, 10.0), (0.0, 0.0, 10.0, 10.0)), words(spark, (0, 0, 10, 10))))
    assert found(out) == [(0, 0, 1.0)]


def test_polygon_overlap_is_clipped(spark):
    triangle = [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0), (0.0, 0.0)]
    r = spark.createDataFrame([("p", 0, "t", None, triangle)], f"page_key string, region_id int, label string, bbox {BOX}, polygon {POINTS}")
    x = overlaps(r, words(spark, (0, 0, 10, 10), (8, 8, 2, 2)), 0.1).collect()
    assert [(o.word_index, o.word_coverage, o.input_geometry_coverage) for o in x] == [(0, 0.5, 1.0)]


def test_self_crossing_polygon_is_an_error(spark):
    bow = [(0.0, 0.0), (10.0, 10.0), (10.0, 0.0), (0.0, 8.0), (0.0, 0.0)]
    r = spark.createDataFrame([("p", 0, "t", None, bow)], f"page_key string, region_id int, label string, bbox {BOX}, polygon {POINTS}")
    with pytest.raises(Exception, match="not valid"):
        overlaps(r, words(spark, (0, 0, 10, 10)), 0.1).collect()


def polygons(spark, *rings):
    closed = [[*r, r[0]] for r in rings]
    return spark.createDataFrame([(k, r) for k, r in enumerate(closed)], f"k int, p {POINTS}")


def test_shared_area_agrees_with_sampling(spark):
    rng = random.Random(3)
    rings = [[(0.0, 0.0), (rng.uniform(5, 9), rng.uniform(-2, 0)), (rng.uniform(8, 10), rng.uniform(4, 8)), (rng.uniform(0, 3), rng.uniform(6, 10))] for _ in range(20)]
    l, t, r, b = 1.0, 1.0, 6.0, 5.0
    box = F.struct(*(F.lit(v).alias(n) for v, n in ((l, "x"), (t, "y"), (r - l, "width"), (b - t, "height"))))
    got = polygons(spark, *rings).select("k", is_valid(F.col("p")).alias("valid"), shared_area(opened(F.col("p")), box).alias("area")).collect()
    for x in got:
        # a convex ring, so that a half-plane test can stand in
        ring = rings[x.k]
        inside = lambda p: len({(q[0] - a[0]) * (p[1] - a[1]) - (q[1] - a[1]) * (p[0] - a[0]) > 0 for a, q in zip(ring, ring[1:] + ring[:1])}) == 1
        if x.valid and all(inside(((p[0] + sum(c[0] for c in ring)) / 5, (p[1] + sum(c[1] for c in ring)) / 5)) for p in ring):
            n = 120
            hits = sum(inside((l + (i + 0.5) / n * (r - l), t + (j + 0.5) / n * (b - t))) for i in range(n) for j in range(n))
            assert x.area == pytest.approx(hits / n / n * (r - l) * (b - t), abs=0.15)


def test_valid_rings(spark):
    cases = [
        ([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], True),
        ([(0.0, 0.0), (4.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], True),  # a repeated point
        ([(0.0, 0.0), (2.0, 0.0), (4.0, 0.0), (4.0, 4.0)], True),  # a point on a side
        ([(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0)], False),  # a bow
        ([(0.0, 0.0), (4.0, 0.0), (2.0, 0.0), (2.0, 4.0)], False),  # back on itself
        ([(0.0, 0.0), (4.0, 0.0), (8.0, 0.0)], False),  # no area
        ([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 0.0), (0.0, 4.0)], False),  # a corner on another side
    ]
    got = {r.k: r.valid for r in polygons(spark, *(ring for ring, _ in cases)).select("k", is_valid(F.col("p")).alias("valid")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases)}
    assert spark.range(1).select(is_valid(F.lit(None).cast(POINTS))).first()[0] is None


def word(x, y, w, h, line=None, block=0):
    return (float(x), float(y), float(w), float(h), line, block)


def rings(spark, *regions_):
    rows = [(k, [(i, *w) for i, w in enumerate(ws)]) for k, ws in enumerate(regions_)]
    df = spark.createDataFrame(rows, "k int, words array<struct<word_index:int,x:double,y:double,width:double,height:double,line_index:int,block_index:int>>")
    found = df.select("k", orthogonal_polygon(F.col("words")).alias("ring")).collect()
    return [r.ring and [(p.x, p.y) for p in r.ring] for r in sorted(found)]


def test_a_gap_that_flat_words_cut_is_one_gap(spark):
    got = rings(
        spark,
        [word(0, 0, 100, 10, 0), word(50, 20, 100, 10, 1), word(60, 15, 20, 0, 2)],
        [word(0, 0, 10, 10, 0), word(30, 40, 10, 10, 1), word(32, 20, 5, 0, 2), word(35, 30, 5, 0, 3)],  # nothing in common: all of it
    )
    assert got[0] == [(0, 0), (100, 0), (100, 20), (150, 20), (150, 30), (50, 30), (50, 10), (0, 10), (0, 0)]
    assert got[1] == [(0, 0), (10, 0), (10, 10), (40, 10), (40, 50), (30, 50), (30, 40), (0, 40), (0, 0)]


def test_outlines(spark):
    got = rings(
        spark,
        [word(1, 2, 3, 4, 0)],
        [word(0, 0, 20, 10, 0), word(0, 10, 10, 10, 1)],  # an L, clockwise from the top left
        [word(0, 0, 20, 10, 0), word(10, 20, 20, 10, 1)],  # a gap is bridged over the common width
        [word(0, 0, 10, 10, 0), word(0, 10, 10, 10, 1)],  # equal lines are one box
        [word(0, 0, 10, 10, 0), word(10, 10, 10, 10, 1)],  # strips that touch at a corner
        [word(0, 0, 10, 10, 0, 0), word(0, 20, 30, 10, 0, 1)],  # lines of different blocks
        [word(5, 5, 0, 0, 0)],
        [word(0, 0, 9, 9, 0), word(20, 4, 0, 0, 1)],  # a point beside
        [],
    )
    assert got == [
        [(1, 2), (4, 2), (4, 6), (1, 6), (1, 2)],
        [(0, 0), (20, 0), (20, 10), (10, 10), (10, 20), (0, 20), (0, 0)],
        [(0, 0), (20, 0), (20, 20), (30, 20), (30, 30), (10, 30), (10, 10), (0, 10), (0, 0)],
        [(0, 0), (10, 0), (10, 20), (0, 20), (0, 0)],
        [(0, 0), (20, 0), (20, 20), (0, 20), (0, 0)],
        [(0, 0), (10, 0), (10, 20), (30, 20), (30, 30), (0, 30), (0, 0)],
        [(5, 5)] * 5,
        [(0, 0), (20, 0), (20, 9), (0, 9), (0, 0)],
        None,
    ]


def test_outlines_have_the_area_of_their_rows(spark):
    """Row by row of height one: as wide as the lines there, or as what neighbours have in common."""
    rng = random.Random(5)
    pages = [[word(rng.randrange(0, 60), rng.randrange(0, 5) * 12 + rng.randrange(3), rng.randrange(1, 30), 10, rng.choice([None, 0, 1, 2])) for _ in range(rng.randrange(1, 7))] for _ in range(120)]
    for ws, ring in zip(pages, rings(spark, *pages), strict=True):
        lines = {}
        for k, (x, y, w, h, line, _) in enumerate(ws):
            lines.setdefault(("alone", k) if line is None else line, []).append((x, y, x + w, y + h))
        boxes = [(min(b[0] for b in bs), min(b[1] for b in bs), max(b[2] for b in bs), max(b[3] for b in bs)) for bs in lines.values()]
        top, bottom = int(min(b[1] for b in boxes)), int(max(b[3] for b in boxes))
        row = lambda y: [b for b in boxes if b[1] <= y < b[3]]
        wide = [(min(b[0] for b in row(y)), max(b[2] for b in row(y))) if row(y) else None for y in range(top, bottom)]
        full = list(wide)
        for k, w in enumerate(full):
            if w is None:
                above, below = next(x for x in full[k::-1] if x), next(x for x in full[k:] if x)
                left, right = max(above[0], below[0]), min(above[1], below[1])
                wide[k] = (left, right) if left < right else (min(above[0], below[0]), max(above[1], below[1]))
        joined = all(max(a[0], b[0]) < min(a[1], b[1]) for a, b in zip(wide, wide[1:]))
        area = sum(r - l for l, r in wide) if joined else (max(b[2] for b in boxes) - min(b[0] for b in boxes)) * (bottom - top)
        assert ring[0] == ring[-1] == min(ring[:-1], key=lambda p: (p[1], p[0]))
        assert sum((a[0] * b[1] - b[0] * a[1]) / 2 for a, b in zip(ring, ring[1:])) == pytest.approx(area)
        assert all((a[0] == b[0]) != (a[1] == b[1]) and (a[0] == b[0]) != (b[0] == c[0]) for a, b, c in zip(ring, ring[1:], [*ring[2:], ring[1]]))


def test_quality_issues(spark):
    df = spark.createDataFrame([(((-1.0, 0.0, 4.0, 4.0)), None), ((0.0, 0.0, float("nan"), 20.0), None), ((0.0, 0.0, 20.0, 20.0), None)], f"bbox {BOX}, polygon {POINTS}")
    got = [r.q for r in df.select(G.quality_issues(F.col("bbox"), F.col("polygon")).alias("q")).collect()]
    assert got[0] == ["negative coordinate", "width below 5", "height below 5", "area below 100"]
    assert got[1][0] == "non-finite coordinate" and got[2] == []


def test_empty_tables(spark):
    out = GeometryAlignment(geometry_format="polygon").align(regions(spark), words(spark, (0, 0, 1, 1)))
    assert out.count() == 0
    out = GeometryAlignment().align(regions(spark, (0.0, 0.0, 9.0, 9.0)), words(spark))
    assert [r.words for r in out.collect()] == [None]
