"""Readers, writers, runs and the stream against literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from glyphgrid.functions import geometry as G
from glyphgrid.operators.labels import checked_mapping, mapped, read_mapping
from glyphgrid.operators.candidates import exact_candidates
from glyphgrid.plans import runs
from glyphgrid.plans.aligners import GeometryAlignment, TextAlignment
from glyphgrid.sinks import json_pages, label_studio as ls_sink
from glyphgrid.sources import alto, files, json_tree, label_studio, yolo
from glyphgrid.streaming.pages import align_arriving

ALTO = """<alto xmlns="http://x"><Layout><Page ID="page-1" WIDTH="100" HEIGHT="200"><PrintSpace>
<ComposedBlock><TextBlock><TextLine><String ID="w1" CONTENT="ROME" HPOS="1" VPOS="2" WIDTH="30" HEIGHT="10"/><SP/><String CONTENT="&amp; co" HPOS="40" VPOS="2" WIDTH="30" HEIGHT="10"/></TextLine></TextBlock></ComposedBlock>
<TextBlock><TextLine><String CONTENT="two" HPOS="1" VPOS="20" WIDTH="30" HEIGHT="10"/></TextLine><String CONTENT="bare" HPOS="1" VPOS="40" WIDTH="5" HEIGHT="5"/></TextBlock></PrintSpace></Page>
<Page ID="p2"><PrintSpace><String CONTENT="last" HPOS="0" VPOS="0" WIDTH="1" HEIGHT="1"/></PrintSpace></Page></Layout></alto>"""


def test_alto_blocks_and_lines():
    page_id, width, height, words = alto.parse(ALTO)
    assert (page_id, width, height) == ("page-1", 100.0, 200.0)
    assert [(w[1], w[6], w[7], w[8]) for w in words] == [("ROME", 0, 0, "w1"), ("& co", 0, 0, None), ("two", 1, 1, None), ("bare", None, 1, None), ("last", None, None, None)]
    assert alto.parse("<alto/>") == (None, None, None, [])
    with pytest.raises(ValueError, match="lacks"):
        alto.parse('<alto><String CONTENT="x"/></alto>')
    with pytest.raises(ValueError, match="invalid"):
        alto.parse("<alto>")


def paths(data, **options):
    return [(json_tree.formatted(r["text_path"]), json_tree.formatted(r["geometry_path"]), r["input"]) for r in json_tree.text_values(data, **options)]


def test_text_values():
    assert paths({"publisher": ["First", "Second"]}) == [("$.publisher[0]", "$.publisher_bbox[0]", "First"), ("$.publisher[1]", "$.publisher_bbox[1]", "Second")]
    assert paths({"title": "x", "title_polygon": [1]}, suffix="_polygon") == []
    assert len(paths({"title": "x", "title_bbox": {}}, overwrite=True)) == 1
    assert paths({"a": {"b": "x"}, "a_bbox": None}) == []
    assert paths({"z": 1, "b": True, "n": None, "f": 1e20, "odd key": "v"}) == [("$.z", "$.z_bbox", 1), ("$.f", "$.f_bbox", 1e20), ('$["odd key"]', '$["odd key_bbox"]', "v")]
    assert paths({"groups": [["A"], [{"name": "C"}]]}) == [("$.groups[0][0]", "$.groups_bbox[0][0]", "A"), ("$.groups[1][0].name", "$.groups[1][0].name_bbox", "C")]
    with pytest.raises(TypeError):
        paths(["a"])


BOX = {"x": 1, "y": 2, "width": 3, "height": 4}


def test_geometries():
    got = list(json_tree.geometries({"groups": [{"publisher_bbox": [BOX, None, BOX]}]}))
    assert [json_tree.formatted(g["geometry_path"]) for g in got] == ["$.groups[0].publisher_bbox[0]", "$.groups[0].publisher_bbox[2]"]
    assert [json_tree.formatted(g["text_path"]) for g in got] == ["$.groups[0].publisher[0]", "$.groups[0].publisher[2]"]
    assert list(json_tree.geometries({"title": "x", "title_bbox": {"not": "a bbox"}})) == []
    assert len(list(json_tree.geometries({"a": None, "a_bbox": BOX, "b": "", "b_bbox": BOX}, overwrite=True))) == 2
    with pytest.raises(ValueError, match=r"\$\.title_bbox"):
        list(json_tree.geometries({"title_bbox": {"x": 1, "y": 1, "width": 2}}))
    ring = [[0, 0], [4, 0], [4, 4], [0, 0]]
    assert list(json_tree.geometries({"t_bbox": ring}))[0]["polygon"][1] == {"x": 4.0, "y": 0.0}
    for bad in ({"t_bbox": [[0, 0], [4, 0], [4, 4], [0, 4]]}, {"_bbox": BOX}, {"t_bbox": 5}, {"t_bbox": {**BOX, "width": 0}}):
        with pytest.raises(ValueError):
            list(json_tree.geometries(bad))
    with pytest.raises(TypeError):
        list(json_tree.geometries({"t_bbox": {**BOX, "x": True}}))


def test_bad_documents_are_errors_or_rows(spark):
    docs = spark.createDataFrame([("a", '{"t": "x"}'), ("b", "{")], "page_key string, raw string")
    with pytest.raises(Exception, match="page b"):
        json_tree.text_regions(docs).collect()
    rows = {r.page_key: r for r in json_tree.text_regions(docs, strict=False).collect()}
    assert rows["a"].label == "t" and rows["b"].error and rows["b"].region_id is None


def lines(spark, *raw):
    return spark.createDataFrame([("p", k, x) for k, x in enumerate(raw)], "page_key string, line_no int, raw string")


def test_yolo_lines(spark):
    r = yolo.detections(lines(spark, "", "3 25 30 30 10 0.875 Page   Number", " ")).collect()
    assert [(x.region_id, x.label, x.category_id, tuple(x.bbox), x.confidence) for x in r] == [(0, "Page Number", 3, (10.0, 25.0, 30.0, 10.0), 0.875)]
    for bad in ("1 2 3 4 5 0.5", "-1 1 1 1 1 0.5 a", "1 1 1 0 1 0.5 a", "1 1 1 1 1 1.5 a", "1 nan 1 1 1 0.5 a", "x 1 1 1 1 0.5 a"):
        assert yolo.detections(lines(spark, bad), strict=False).first().error
        with pytest.raises(Exception, match="line 0"):
            yolo.detections(lines(spark, bad)).collect()


def test_yolo_dedup(spark):
    group = [yolo.Group(frozenset({"Chapter", "Subchapter"}), 0.8)]
    kept = lambda *raw: sorted(x.region_id for x in yolo.deduplicated(yolo.detections(lines(spark, *raw)), group).collect())
    assert kept("0 5 5 10 10 0.7 Chapter", "1 5 5 10 10 0.9 Subchapter", "2 5 5 10 10 0.1 Other") == [1, 2]
    assert kept("0 5 5 10 10 0.7 Chapter", "0 5 5 10 10 0.9 Chapter") == [0, 1]
    assert kept("0 5 5 10 10 0.7 Chapter", "1 5 5 2 2 0.9 Subchapter") == [0, 1]
    assert kept("0 5 5 10 10 0.7 Chapter", "1 5 5 10 10 0.7 Subchapter") == [0]
    with pytest.raises(ValueError):
        yolo.deduplicated(yolo.detections(lines(spark)), group * 2)
    with pytest.raises(ValueError):
        yolo.Group(frozenset({"a"}), 0.5)


def test_label_studio_reading(spark):
    rect = {"type": "rectanglelabels", "original_width": 1000, "original_height": 500, "value": {"x": 10, "y": 20, "width": 30, "height": 40, "rectanglelabels": ["T"]}}
    notes = [{"created_at": "2024-01-01T00:00:00Z", "result": []}, {"created_at": "2024-01-01T00:00:00Z", "result": [{"type": "choices"}, rect]}, {"created_at": "2025-01-01T00:00:00Z", "was_cancelled": True, "result": []}, {"result": []}]
    task = [{"id": 1, "data": {"image": "/data/local-files/?d=images%2Fpage.one.jpg"}, "annotations": notes}]
    read = lambda t: label_studio.regions(spark.createDataFrame([("e", json.dumps(t))], "export string, raw string"))
    r = read(task).collect()
    assert [(x.page_key, x.region_id, x.label, tuple(x.bbox)) for x in r] == [("page.one", 0, "T", (100.0, 100.0, 300.0, 200.0))]
    assert json_tree.formatted(json_pages.tuple_path(r[0].geometry_path)) == "$[0].annotations[1].result[1].value"
    rect["value"]["rotation"] = 5
    with pytest.raises(Exception, match="rotated"):
        read(task).collect()
    assert label_studio.key_of_image("http://h/a/b%20c.png?x=1") == "b c" and label_studio.key_of_image("/?d=") is None


def test_label_mapping(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text('{"Title": "heading", "heading": "again"}')
    m = read_mapping(spark, str(p))
    assert [r.label_export for r in mapped(spark.createDataFrame([("Title",), ("x",)], "label string"), m).collect()] == ["heading", None]
    p.write_text('{"a": "b", "a": "c"}')
    with pytest.raises(ValueError):
        read_mapping(spark, str(p))
    for bad in ({"a": ""}, {" ": "x"}):
        with pytest.raises(ValueError):
            checked_mapping(bad)
    with pytest.raises(TypeError):
        checked_mapping({"a": 1})


def test_page_keys(spark):
    names = ["a/p.full.xml", "a/.hidden", "p", "x/.b.json"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "p string").select(files.page_key_of(F.col("p"))).collect()]
    assert got == [files.page_key(n) for n in names]


def test_put_pads_and_checks():
    root = {"a": [1]}
    json_pages.put(root, ("a", 3), "x")
    json_pages.put(root, ("b", 1, "c"), 2)
    assert root == {"a": [1, None, None, "x"], "b": [None, {"c": 2}]}
    for path in (("a", "k"), ("b", 1, 0), ("a", 0, "k")):
        with pytest.raises(TypeError):
            json_pages.put(root, path, 1)
    with pytest.raises(ValueError):
        json_pages.put(root, (), 1)


def test_clean_numbers(spark):
    got = [r[0] for r in spark.createDataFrame([(1.0,), (1.5,), (2.0000000001,), (-3.0,)], "v double").select(G.clean_number(F.col("v"))).collect()]
    assert got == ["1", "1.5", "2", "-3"]


@pytest.fixture()
def folders(tmp_path):
    for name in ("alto", "json", "yolo"):
        (tmp_path / name).mkdir()
    (tmp_path / "alto/p.XML").write_text(ALTO)
    (tmp_path / "json/p.json").write_text(json.dumps({"city": "ROME", "names": ["two", "none"], "area_bbox": {"x": 0, "y": 0, "width": 35, "height": 15}}))
    (tmp_path / "json/q.json").write_text("{}")
    (tmp_path / "yolo/p.txt").write_text("0 18 8 36 16 0.5 City name\n1 90 90 5 5 0.25 Empty\n")
    return tmp_path


def out(folder):
    return json.loads((folder / "out/p.json").read_text())


def test_text_run(spark, folders):
    found = runs.main(["text", "--alto-dir", str(folders / "alto"), "--input-dir", str(folders / "json"), "--json-output-dir", str(folders / "out"), "--text-normalizer", "lowercase"], spark)
    assert out(folders) == {"city": "ROME", "names": ["two", "none"], "area_bbox": {"x": 0, "y": 0, "width": 35, "height": 15}, "names_bbox": [{"x": 1, "y": 20, "width": 30, "height": 10}, None], "city_bbox": {"x": 1, "y": 2, "width": 30, "height": 10}}
    assert tuple(found.summary.first())[:4] == (1, 3, 2, 1)
    assert [r.page_key for r in found.unpaired.collect()] == ["q"]


def test_text_run_counts_ambiguous_and_conflicted(spark, folders):
    # "last" stands twice for one value, and "two" is wanted by two values
    words = "".join(f'<String ID="s{k}" CONTENT="{t}" HPOS="{20 * k}" VPOS="1" WIDTH="15" HEIGHT="10"/>' for k, t in enumerate(["last", "two", "last"]))
    alto_xml = f'<alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Layout><Page WIDTH="100" HEIGHT="100"><PrintSpace><TextBlock ID="b"><TextLine ID="l">{words}</TextLine></TextBlock></PrintSpace></Page></Layout></alto>'
    for folder, name, content in (("alto2", "z.xml", alto_xml), ("json2", "z.json", '{"a": "last", "b": "two", "c": "two"}')):
        (folders / folder).mkdir()
        (folders / folder / name).write_text(content)
    found = runs.run(spark, "text", TextAlignment(generator="exact"), str(folders / "alto2"), str(folders / "json2"))
    assert found.summary.first().asDict() == {"pages": 1, "regions": 3, "matched": 2, "unmatched": 1, "ambiguous": 1, "conflicted": 1}


def test_geometry_run(spark, folders):
    runs.main(["geometry", "--alto-dir", str(folders / "alto"), "--input-dir", str(folders / "json"), "--json-output-dir", str(folders / "out"), "--output-geometry-source", "alto"], spark)
    assert out(folders)["area"] == "ROME last" and out(folders)["area_bbox"] == {"x": 0, "y": 0, "width": 31, "height": 12}


def test_yolo_run_and_label_studio_output(spark, folders):
    args = ["geometry", "--alto-dir", str(folders / "alto"), "--input-dir", str(folders / "yolo"), "--json-output-dir", str(folders / "out"), "--input-format", "yolo"]
    runs.main(args, spark)
    assert out(folders) == {"City name": ["ROME last"], "City name_bbox": [{"x": 0, "y": 0, "width": 36, "height": 16}], "Empty": [None], "Empty_bbox": [{"x": 87.5, "y": 87.5, "width": 5, "height": 5}]}
    runs.main([*args, "--output-json-format", "label-studio", "--label-studio-image-prefix", "s3://b/"], spark)
    task = out(folders)
    result = task["predictions"][0]["result"]
    assert task["data"]["image"] == "s3://b/p.jpg" and len(result) == 1
    assert result[0]["value"] == {"x": 0, "y": 0, "width": 36, "height": 8, "rectanglelabels": ["City name"]} and result[0]["meta"]["text"] == ["ROME last"]
    assert task["predictions"][0]["score"] == result[0]["score"] == 0.5


def test_categories_belong_together_across_pages(spark, folders):
    (folders / "alto/q.xml").write_text(ALTO)
    (folders / "yolo/q.txt").write_text("0 18 8 36 16 0.5 Other name\n")
    with pytest.raises(ValueError, match="across"):
        runs.run(spark, "geometry", GeometryAlignment(), str(folders / "alto"), str(folders / "yolo"), "yolo")


def test_files_keep_their_order_and_folders(spark, folders):
    (folders / "more").mkdir()
    for name in ("c", "a", "b"):
        (folders / "alto" / f"{name}.xml").write_text(ALTO)
        (folders / ("more" if name == "a" else "json") / f"{name}.json").write_text('{"city": "ROME"}')
    (folders / "json/a.json").write_text('{"city": "another file of this name"}')
    inputs = [str(folders / x) for x in ("json/c.json", "more/a.json", "json/b.json")]
    found = runs.run(spark, "text", TextAlignment(generator="exact"), [str(folders / f"alto/{x}.xml") for x in "abc"], inputs)
    assert [r.page_key for r in found.documents.orderBy("page_ordinal").collect()] == [r.page_key for r in found.pages.orderBy("page_ordinal").collect()] == ["c", "a", "b"]
    assert found.aligned.count() == 3 and {r.input_text for r in found.aligned.collect()} == {"ROME"}


def label_studio_task(image, **value):
    box = {"x": 0, "y": 0, "width": 36, "height": 8, "rectanglelabels": ["City"]} | value
    return {"id": 1, "data": {"image": image}, "annotations": [{"result": [{"type": "rectanglelabels", "original_width": 100, "original_height": 200, "image_rotation": 0, "value": box}]}]}


def test_label_studio_run(spark, folders):
    (folders / "exports").mkdir()
    (folders / "exports/one.json").write_text(json.dumps([label_studio_task("s3://b/p.jpg"), label_studio_task("s3://b/absent.jpg")]))
    found = runs.run(spark, "geometry", GeometryAlignment(), str(folders / "alto"), str(folders / "exports"), "label-studio")
    assert [(r.page_key, r.label, r.alto_text) for r in found.aligned.collect()] == [("p", "City", "ROME last")]
    assert [r.page_key for r in found.unpaired.collect()] == ["absent"]


def test_two_tasks_of_a_page_are_an_error(spark):
    raw = json.dumps([label_studio_task("s3://b/p.jpg"), label_studio_task("s3://c/p.png")])
    with pytest.raises(Exception, match="more than one task"):
        label_studio.regions(spark.createDataFrame([("e", raw)], "export string, raw string")).collect()


def test_parts_of_an_alignment_can_be_functions(spark):
    words = spark.createDataFrame([("p", 0, "ab", 0.0, 0.0, 9.0, 9.0, 0, 0), ("p", 1, "cd", 10.0, 0.0, 9.0, 9.0, 0, 0)], "page_key string, word_index int, text string, x double, y double, width double, height double, line_index int, block_index int")
    regions = spark.createDataFrame([("p", 0, "r", "cd", (0.0, 0.0, 30.0, 9.0))], "page_key string, region_id int, label string, input_text string, bbox struct<x:double,y:double,width:double,height:double>")
    first = lambda met: met.filter("word_index = 0")
    plan = GeometryAlignment(assignment=first, text=lambda ws: F.array_join(F.transform(ws, lambda w: F.upper(w["text"])), "+"))
    assert plan.align(regions, words).first().alto_text == "AB"
    plan = TextAlignment(generator=exact_candidates, selector=lambda found: found, geometry_format="polygon", outline=lambda ws: F.transform(ws, lambda w: F.struct(w["x"].alias("x"), w["y"].alias("y"))))
    assert [tuple(p) for p in plan.align(regions, words).first().alto_polygon] == [(10.0, 0.0)]


def test_missing_pages_can_fail(spark, folders):
    with pytest.raises(ValueError, match="q"):
        runs.run(spark, "text", TextAlignment(), str(folders / "alto"), str(folders / "json"), fail_on_missing=True)
    for args in (["text"], ["geometry", "--alto-dir", "a", "--input-dir", "b", "--json-output-dir", "c", "--output-json-format", "label-studio"]):
        with pytest.raises(SystemExit):
            runs.main(args, spark)


def test_grouped_labels_collide(spark):
    box = (0.0, 0.0, 1.0, 1.0)
    rows = [("p", 0, "a", None, box, None, "t"), ("p", 1, "a_bbox", None, box, None, None)]
    b, r = "struct<x:double,y:double,width:double,height:double>", "array<struct<x:double,y:double>>"
    df = spark.createDataFrame(rows, f"page_key string, region_id int, label string, label_export string, bbox {b}, polygon {r}, alto_text string").withColumn("alto_bbox", F.col("bbox")).withColumn("alto_polygon", F.col("polygon"))
    with pytest.raises(Exception, match="collide"):
        json_pages.grouped_documents(df).collect()
    assert json.loads(json_pages.grouped_documents(df.filter("region_id = 0")).first().json) == {"a": ["t"], "a_bbox": [{"x": 0, "y": 0, "width": 1, "height": 1}]}


def test_label_studio_needs_sizes(spark):
    b, r = "struct<x:double,y:double,width:double,height:double>", "array<struct<x:double,y:double>>"
    df = spark.createDataFrame([("p", 0, "a", None, (1.0, 1.0, 2.0, 2.0), None, "t", 0.5)], f"page_key string, region_id int, label string, label_export string, bbox {b}, polygon {r}, alto_text string, alignment_score double").withColumn("alto_bbox", F.col("bbox")).withColumn("alto_polygon", F.col("polygon"))
    with pytest.raises(Exception, match="sizes"):
        ls_sink.results(df, spark.createDataFrame([("p", 0.0, 5.0)], "page_key string, alto_width double, alto_height double")).collect()


def test_stream(spark, folders):
    b = "struct<x:double,y:double,width:double,height:double>"
    (folders / "alto/p.XML").rename(folders / "alto/p.xml")
    regions = spark.createDataFrame([("p", 0, "city", (0.0, 0.0, 35.0, 15.0)), ("q", 0, "city", (0.0, 0.0, 35.0, 15.0))], f"page_key string, region_id int, label string, bbox {b}")
    q = align_arriving(spark, str(folders / "alto"), regions, str(folders / "aligned"), str(folders / "checkpoint"), GeometryAlignment(polygons=False))
    assert q.awaitTermination(120)
    assert [r.alto_text for r in spark.read.parquet(str(folders / "aligned")).collect()] == ["ROME last"]
