"""What grows with the input: exchanges of views, batches, and work on pairs of texts."""

import os
import random
import re
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphgrid.functions.polygons import opened, shared_area, shared_areas
from glyphgrid.operators import ordered
from glyphgrid.plans import views as V
from glyphgrid.sources import alto

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
def test_views_need_no_exchange(spark):
    for df in (V.ocr_words(spark, SMALL), V.geom_regions(spark, SMALL), V.text_values(spark, SMALL, ascii_only=True).filter("region_id < 0")):
        assert "Window" not in plan_of(df)
    assert "Exchange" not in plan_of(V.ocr_words(spark, SMALL)) + plan_of(V.geom_regions(spark, SMALL))


def test_odd_texts_are_laid_out(spark):
    texts = ["", " ", "\n", "a", "  aé b\n\n c  \U0001f600d ", "x\n y", None]
    rows = V.laid_out(spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "page_key string, text string").coalesce(1)).orderBy("page_key", "word_index").collect()
    assert [(r["page_key"], r["word_index"], r["text"], r["x"], r["width"], r["line_index"]) for r in rows] == [
        ("3", 0, "a", 0, 8, 0), ("4", 0, "aé", 20, 18, 0), ("4", 1, "b", 50, 8, 0), ("4", 2, "c", 10, 8, 2), ("4", 3, "\U0001f600d", 40, 18, 2), ("5", 0, "x", 0, 8, 0), ("5", 1, "y", 10, 8, 1),
    ]


def test_shared_areas_of_many_polygons(spark):
    draw = random.Random(3)
    rings = [[(0.0, 0.0), (8.0, 0.0), (8.0, 4.0), (4.0, 4.0), (4.0, 8.0), (0.0, 8.0), (0.0, 0.0)], [(1.0, 1.0), (9.0, 2.0), (3.0, 7.0)], [(0.0, 0.0), (5.0, 0.0), (5.0, 0.0), (0.0, 6.0)]] * 20
    boxes = [[draw.uniform(-2, 9), draw.uniform(-2, 9), draw.uniform(0.1, 9), draw.uniform(0.1, 9)] for _ in rings]
    df = spark.createDataFrame([(k, r, b) for k, (r, b) in enumerate(zip(rings, boxes, strict=True))], "k int, p array<struct<x:double,y:double>>, b array<double>")
    box = F.struct(*(F.get("b", F.lit(i)).alias(n) for i, n in enumerate(("x", "y", "width", "height"))))
    want = [r["a"] for r in df.select("k", shared_area(opened(F.col("p")), box).alias("a")).orderBy("k").collect()]
    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    given = pa.array([None, *([{"x": x, "y": y} for x, y in r] for r in rings)], kind)
    got = shared_areas(given, *(np.array([0.0, *c]) for c in zip(*boxes, strict=True)))
    assert np.allclose(got[1:], want, atol=1e-9)


def test_parsed_pages_go_on_before_all_are_parsed(monkeypatch):
    monkeypatch.setattr(alto, "HELD", 5)
    page = '<alto><Layout><Page ID="p">' + '<String CONTENT="a" HPOS="0" VPOS="0" WIDTH="1" HEIGHT="1"/>' * 3 + "</Page></Layout></alto>"
    files = pd.DataFrame([(str(k), "f", page) for k in range(5)], columns=["page_key", "path", "content"])
    assert [list(f["page_key"]) for f in alto.parsed_frames(iter([files]))] == [["0", "1"], ["2", "3"], ["4"]]


def test_few_edits_are_the_same_path(monkeypatch):
    draw = random.Random(5)
    pairs = []
    for _ in range(300):
        a = "".join(draw.choices("abc ", k=draw.randrange(0, 30)))
        b = "".join(draw.choice(["", c, c, c, c + "x", "y"]) for c in a) if draw.random() < 0.7 else "".join(draw.choices("abc ", k=draw.randrange(0, 30)))
        pairs.append((a, b))
    few = [ordered.aligned_characters(a, b).tolist() for a, b in pairs]
    monkeypatch.setattr(ordered, "few_edits", lambda *_: False)
    assert few == [ordered.aligned_characters(a, b).tolist() for a, b in pairs]


def test_long_texts_with_few_edits_are_quick():
    draw = random.Random(7)
    a = "".join(draw.choices("abcdefgh ", k=200_000))
    b = "".join("#" if k % 2_000 == 0 else c for k, c in enumerate(a))
    start = time.time()
    assert (ordered.aligned_characters(a, b) == np.arange(len(a))).all()
    assert time.time() - start < 3


def searched(spark, wanted=None):
    from glyphgrid.functions.text import collapse_blanks
    from glyphgrid.operators import candidates as C
    from glyphgrid.operators.textindex import index_words

    pages = [("p", "one two, three four five one two three four six"), ("q", "nothing like it here at all"), ("r", "unasked words")]
    words = V.laid_out(spark.createDataFrame(pages, "page_key string, text string"))
    values = spark.createDataFrame([("p", 0, "three four"), ("p", 1, "twoo three"), ("p", 2, "zzyzx qqqqq"), ("q", 0, "likeit hexe"), ("q", 1, "xx")], "page_key string, region_id int, input_text string").withColumn("norm", F.col("input_text"))
    return C, values, index_words(words, collapse_blanks)


def test_only_pages_and_words_asked_for_are_searched(spark):
    C, values, index = searched(spark)
    pages = C.prepared(values, index)
    assert {r["page_key"] for r in pages.collect()} == {"p", "q"}
    held = C.words_of(pages).filter(C.is_wanted(F.lit(0), F.col("norm")))
    assert {r["norm"] for r in held.collect()} == {"three", "four"}


def test_pages_with_very_many_queries_are_searched_whole(spark, monkeypatch):
    C, values, index = searched(spark)
    found = [tuple(r) for r in C.exact_and_fuzzy(values, index).orderBy("page_key", "candidate_id").collect()]
    monkeypatch.setattr(C, "WANTED", 0)
    assert found == [tuple(r) for r in C.exact_and_fuzzy(values, index).orderBy("page_key", "candidate_id").collect()]
    spans = [(r[2], r[3], r[4], r[-1]) for r in found if r[0] == "p"]
    assert (0, 2, 3, "exact") in spans and (0, 7, 8, "exact") in spans and any(s[:3] == (1, 6, 7) for s in spans)


@needs_data
def test_counts_gather_no_words(spark):
    from glyphgrid.plans import catalogue

    for name in ("match_counts", "run_summary", "unmatched_regions"):
        assert "collect_list" not in catalogue.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def exchanged(df):
    """What the exchanges of a plan deal by, when no join is broadcast."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return [re.findall(r"([a-z_]+)#", dealt) for dealt in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan_of(df.select("*")))]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@needs_data
def test_pages_are_exchanged_once_for_an_alignment(spark):
    from glyphgrid.plans import catalogue

    for name, sides in (("geometry_align_flagship", 3), ("assign_greatest_coverage", 2), ("bbox_overlap_bidirectional", 2), ("grouped_labels", 3), ("orthogonal_polygon", 3)):
        assert exchanged(catalogue.QUERIES[name](spark, SMALL)) == [["page_key"]] * sides, name


def test_texts_exchanged_by_page_are_laid_out_alike(spark):
    texts = ["", " ", "\n", "a", "  aé b\n\n c  \U0001f600d ", "x\n y", None, "tab\there   nbsp\r\nend  "]
    pages = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "page_key string, text string")
    plain, dealt = (f(pages).orderBy("page_key", "word_index").collect() for f in (V.laid_out, V.laid_out_by_page))
    assert plain == dealt and len(plain) > 8


def test_exact_search_gathers_no_pages(spark, monkeypatch):
    C, values, index = searched(spark)
    monkeypatch.setattr(C, "page_arrays", lambda index: 1 / 0)
    found = C.exact_candidates(values, index).orderBy("start_word").collect()
    assert [(r["page_key"], r["region_id"], r["start_word"], r["end_word"], r["matched_text"]) for r in found] == [("p", 0, 2, 3, "three four"), ("p", 0, 7, 8, "three four")]


@needs_data
def test_searched_pages_are_not_exchanged(spark):
    """Written pages meet what is asked of them where they lie: only values, and candidates to be numbered, go by page."""
    from glyphgrid.plans import catalogue

    dealt = exchanged(catalogue.QUERIES["fuzzy_candidates"](spark, SMALL))
    assert 0 < len(dealt) <= 2 and all(d == ["page_key"] for d in dealt)


def test_what_is_near_holds_a_piece(spark):
    from glyphgrid.operators import candidates as C

    draw = random.Random(11)
    rows = []
    for k in range(400):
        query = "".join(draw.choices("ab c", k=draw.randrange(1, 15)))
        near = "".join(draw.choice(["", c, c, c, c, c + "x", "y"]) for c in query)
        rows.append((k, query, "q" + near + "éz", near, draw.randrange(0, 4)))
    df = spark.createDataFrame(rows, "k int, query string, text string, near string, most int")
    page = F.array(F.struct(F.col("text").alias("norm")))
    asked = F.array(F.struct("query", C.pieces(F.col("query"), F.col("most")).alias("pieces")))
    told = df.select(F.size(C.within_reach(page, asked)).alias("n"), (F.levenshtein("query", "near") <= F.col("most")).alias("close")).collect()
    assert all(r["n"] == 1 for r in told if r["close"]) and any(r["n"] == 0 for r in told) and sum(r["close"] for r in told) > 50
    assert df.limit(1).select(F.size(C.within_reach(F.array(F.struct(F.lit("some words").alias("norm"))), F.array(F.struct(F.lit("zzyzx").alias("query"), C.pieces(F.lit("zzyzx"), F.lit(1)).alias("pieces"))))).alias("n")).first()["n"] == 0


def test_trigrams_of_words_are_cut_without_lists(spark):
    from glyphgrid.functions.text import collapse_blanks
    from glyphgrid.operators.textindex import index_words, trigram_postings

    texts = ["banana", "ab", "aaaa", "ab cde cde", "", "\U0001f600\U0001f601\U0001f602\U0001f600\U0001f601\U0001f602"]
    words = spark.createDataFrame([("p", k, t, 0) for k, t in enumerate(texts)], "page_key string, word_index int, text string, block_index int")
    found = trigram_postings(index_words(words, collapse_blanks))
    want = sorted((k, g) for k, t in enumerate(texts) for g in {w[i : i + 3] for w in t.split() for i in range(len(w) - 2)})
    assert sorted((r["word_index"], r["trigram"]) for r in found.collect()) == want
    assert "array_distinct" not in plan_of(found)


@needs_data
def test_words_are_not_sorted_to_meet_regions(spark):
    from glyphgrid.plans import catalogue

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("bbox_overlap_bidirectional", "assign_all_over_threshold"):
            plan = plan_of(catalogue.QUERIES[name](spark, SMALL).select("*"))
            assert "ShuffledHashJoin" in plan and "Sort " not in plan and "SortMergeJoin" not in plan, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_parts_of_pages_grow_with_what_is_read(spark):
    texts = spark.range(0, 40, 1, 20).selectExpr("string(id) AS page_key", "'a b' AS text")
    few, many = (V.laid_out_by_page(t).rdd.getNumPartitions() for t in (texts.coalesce(1), texts))
    assert (few, many) == (16, 160)


def test_parts_of_a_choice_are_rows_dealt_to_many_tasks(spark):
    from glyphgrid.operators import select as S

    rows = [(f"p{p}", 2 * r + k, r, 3 * k, 3 * k + 2, 9, 1) for p in range(40) for r in range(2) for k in range(2)]
    df = spark.createDataFrame(rows, "page_key string, candidate_id int, region_id int, start_word int, end_word int, quality_chars int, exact int")
    found = S.choices(df)
    assert found.groupBy("page_key").count().filter("count = 2").count() == 40
    assert "FlatMapGroupsInPandas" not in plan_of(found) and "REPARTITION_BY_NUM" in plan_of(found)


@needs_data
def test_pages_of_files_are_put_together_without_an_exchange(spark):
    from glyphgrid.plans import catalogue

    for files in (catalogue.alto_files, catalogue.json_geometry_docs):
        assert "Exchange" not in plan_of(files(spark, SMALL)), files.__name__


def test_json_regions_leave_in_small_frames():
    import json

    from glyphgrid.sources import json_tree

    raw = json.dumps({"regions": [{"Title_bbox": {"x": k, "y": 0, "width": 1, "height": 1}} for k in range(700)]})
    docs = pd.DataFrame([(f"p{k}", raw) for k in range(20)], columns=["page_key", "raw"])
    frames = list(json_tree.walked_frames([docs], json_tree.geometries, True))
    assert max(map(len, frames)) == json_tree.HELD and sum(map(len, frames)) == 20 * 700


def test_filled_documents_take_few_rows_at_a_time(spark):
    from glyphgrid.sinks import json_pages

    docs = spark.createDataFrame([("p", '{"a": "x"}')], "page_key string, raw string")
    path = "array<struct<key:string,idx:int>>"
    box = "struct<x:double,y:double,width:double,height:double>"
    found = spark.createDataFrame([("p", 0, "x", (1.0, 2.0, 3.0, 4.0), None, [("a", None)], [("a_bbox", None)])], f"page_key string, region_id int, alto_text string, alto_bbox {box}, alto_polygon array<struct<x:double,y:double>>, text_path {path}, geometry_path {path}")
    filled = json_pages.filled_documents(docs, found)
    assert "MapInPandas" not in plan_of(filled) and '"width": 3' in filled.first()["json"]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256


def test_pages_are_indexed_in_their_row(spark):
    from glyphgrid.functions.text import collapse_blanks
    from glyphgrid.operators.textindex import index_words, page_arrays

    texts = ["one two\n\n  three", "a\tb   c  d\n e f", "  \n ", "žluť \x1c x\r\ny", "", "plain\ntext of\nfive\nlines\nhere", " \t "]
    docs = spark.createDataFrame([(f"p{k}", t) for k, t in enumerate(texts)] + [("none", None)], "page_key string, text string")
    want = page_arrays(index_words(V.laid_out_by_page(docs), collapse_blanks, by_page=True))
    found = V.indexed_pages(docs)
    order = lambda df: sorted(map(repr, df.select("page_key", "words", "n").collect()))
    assert order(found) == order(want)
    assert "Window" not in plan_of(found) and "Generate" not in plan_of(found) and "Aggregate" not in plan_of(found)


def test_windows_near_starts_are_made_in_the_page(spark):
    from glyphgrid.operators import candidates as C

    draw, options = random.Random(5), C.Fuzzy()
    words = [("w" * draw.randrange(1, 6),) for _ in range(30)]
    starts, ends = [0], []
    for (w,) in words:
        ends.append(starts[-1] + len(w))
        starts.append(ends[-1] + 1)
    page = [(k, None, w, 0, s, None) for k, ((w,), s) in enumerate(zip(words, starts))]
    first, length, most = [-2, 0, 1, 14, 29, 33], 11, 2
    query = "q" * length
    row = spark.createDataFrame([("p", page, (query, 3, most, first))], "page_key string, words array<struct<word_index:int,text:string,norm:string,block_index:int,char_start:int,at:int>>, q struct<query:string,k:int,most:int,starts:array<int>>")
    found = {tuple(r) for r in row.select(F.inline(C.around(F.col("words"), F.col("q"), options))).collect()}
    near = {s + d for s in first for d in (-1, 0, 1)}
    want = {(a, a + c - 1) for a in near for c in range(1, 6) if a >= 0 and a + c <= 30 and abs(length - (ends[a + c - 1] - starts[a])) <= most}
    assert found == want and len(found) == row.select(F.inline(C.around(F.col("words"), F.col("q"), options))).count()
