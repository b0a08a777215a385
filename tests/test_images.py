"""Image sizes from headers written by hand."""

import struct

import pytest

from glyphgrid.plans import runs
from glyphgrid.sources.images import size_of, sizes


def segment(marker, body):
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def tiff(end, entries, big=False):
    order = b"II" if end == "<" else b"MM"
    body = b"pixels come first" + b"\0"
    if big:
        rows = b"".join(struct.pack(f"{end}HHQ", t, k, 1) + struct.pack(end + {3: "H6x", 4: "I4x", 16: "Q"}[k], v) for t, k, v in entries)
        return order + struct.pack(f"{end}HHHQ", 43, 8, 0, 16 + len(body)) + body + struct.pack(f"{end}Q", len(entries)) + rows + bytes(8)
    rows = b"".join(struct.pack(f"{end}HHI", t, k, 1) + struct.pack(end + {3: "H2x", 4: "I"}[k], v) for t, k, v in entries)
    return order + struct.pack(f"{end}HI", 42, 8 + len(body)) + body + struct.pack(f"{end}H", len(entries)) + rows + bytes(4)


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0) + bytes(200)


FRAME = struct.pack(">BHHB", 8, 480, 640, 3) + bytes(9)
IMAGES = {
    "png": (png(640, 480), (640, 480)),
    "jpeg": (b"\xff\xd8" + segment(0xE0, b"JFIF\0" + bytes(9)) + segment(0xE1, bytes(60_000)) * 3 + segment(0xC4, bytes(20)) + b"\xff\xff" + segment(0xC2, FRAME)[1:] + b"\xff\xd9", (640, 480)),
    "bmp": (b"BM" + bytes(12) + struct.pack("<Iii", 40, 33, -21) + bytes(30), (33, 21)),
    "bmp of old": (b"BM" + bytes(12) + struct.pack("<IHH", 12, 33, 21) + bytes(30), (33, 21)),
    "webp x": (b"RIFF\0\0\0\0WEBPVP8X" + struct.pack("<I", 10) + bytes(4) + (1999).to_bytes(3, "little") + (999).to_bytes(3, "little"), (2000, 1000)),
    "webp l": (b"RIFF\0\0\0\0WEBPVP8L" + struct.pack("<I", 10) + b"\x2f" + struct.pack("<I", 299 | 199 << 14) + bytes(9), (300, 200)),
    "webp": (b"RIFF\0\0\0\0WEBPVP8 " + struct.pack("<I", 10) + b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 300 | 1 << 14, 200) + bytes(9), (300, 200)),
    "tiff": (tiff("<", [(254, 4, 0), (256, 3, 77), (257, 4, 55)]), (77, 55)),
    "tiff of motorola": (tiff(">", [(256, 3, 77), (257, 3, 55)]), (77, 55)),
    "big tiff": (tiff("<", [(256, 16, 77), (257, 4, 55)], big=True), (77, 55)),
}


@pytest.mark.parametrize("name", IMAGES)
def test_sizes(name):
    data, size = IMAGES[name]
    assert size_of(data) == size


@pytest.mark.parametrize("data", [b"", b"GIF89a", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff\xe0", b"II*\0\x08\0\0\0\0\0"])
def test_what_is_no_image(data):
    with pytest.raises((ValueError, KeyError, IndexError, struct.error)):
        size_of(data)


def test_frames(spark):
    rows = [(name, f"in/{name}", bytearray(data)) for name, (data, _) in IMAGES.items()]
    df = spark.createDataFrame(rows, "page_key string, path string, content binary")
    assert {r.page_key: (r.image_width, r.image_height) for r in sizes(df).collect()} == {name: size for name, (_, size) in IMAGES.items()}
    assert sizes(df.limit(0)).count() == 0
    broken = spark.createDataFrame([("a", "in/broken.png", bytearray(b"no image"))], df.schema)
    with pytest.raises(Exception, match="in/broken.png"):
        sizes(broken).collect()


def test_a_run_draws_in_true_pixels(spark, tmp_path):
    words = '<String CONTENT="rome" HPOS="10" VPOS="20" WIDTH="30" HEIGHT="10"/>'
    alto = f'<alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Layout><Page WIDTH="100" HEIGHT="50"><PrintSpace><TextBlock ID="b"><TextLine ID="l">{words}</TextLine></TextBlock></PrintSpace></Page></Layout></alto>'
    for folder, name, data in (("alto", "p.xml", alto.encode()), ("json", "p.json", b'{"city": "rome"}'), ("images", "p.png", png(400, 500)), ("alto", "e.xml", alto.encode()), ("json", "e.json", b"{}")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_bytes(data)
    at = lambda name: str(tmp_path / name)
    found = runs.main(["text", "--alto-dir", at("alto"), "--input-dir", at("json"), "--json-output-dir", at("out"), "--images-dir", at("images"), "--render-dir", at("plan"), "--solver-time-limit-seconds", "60"], spark)
    (drawn,) = spark.read.json(at("plan")).collect()
    assert (drawn.page_key, drawn.left, drawn.top, drawn.right, drawn.bottom) == ("p", 40, 200, 160, 300)
    # a page without regions counts as a page
    assert found.summary.first().asDict() == {"pages": 2, "regions": 1, "matched": 1, "unmatched": 0, "ambiguous": 0, "conflicted": 0}
    assert found.candidates.count() == 1 and found.selected.count() == 1 and found.ambiguous.count() == 0


def test_a_run_without_pages(spark, tmp_path):
    (tmp_path / "alto").mkdir()
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "p.json").write_text('{"city": "rome"}')
    found = runs.run(spark, "geometry", runs.GeometryAlignment(), str(tmp_path / "alto"), str(tmp_path / "json"))
    assert tuple(found.summary.first()) == (0, 0, 0, 0, 0, 0) and found.unpaired.count() == 1


def test_writer_drawer_and_box_can_be_replaced(spark, tmp_path):
    from pyspark.sql import functions as F

    from glyphgrid.operators.pairing import require_unique_regions
    from glyphgrid.plans.aligners import TextAlignment

    words = spark.createDataFrame([("p", 0, "rome", 10.0, 20.0, 30.0, 10.0, 0, 0)], "page_key string, word_index int, text string, x double, y double, width double, height double, line_index int, block_index int")
    values = spark.createDataFrame([("p", 0, "city", "rome")], "page_key string, region_id int, label string, input_text string")
    wide = lambda ws: F.struct(*(F.lit(v).alias(n) for n, v in (("x", 0.0), ("y", 0.0), ("width", 1.0), ("height", F.size(ws).cast("double")))))
    assert TextAlignment(generator="exact", box=wide).align(values, words).first().alto_bbox.asDict() == {"x": 0.0, "y": 0.0, "width": 1.0, "height": 1.0}
    with pytest.warns(UserWarning, match="fewer edits"):
        from glyphgrid.operators.candidates import Fuzzy

        TextAlignment(fuzzy=Fuzzy(length_boundary=3, max_cer=0.2, max_edits=1))
    assert require_unique_regions(values).columns == values.columns
    with pytest.raises(Exception, match="more than one region 0 on page p"):
        require_unique_regions(values.union(values)).collect()
    alto = '<alto><Layout><Page WIDTH="100" HEIGHT="50"><PrintSpace><TextBlock><TextLine><String CONTENT="rome" HPOS="10" VPOS="20" WIDTH="30" HEIGHT="10"/></TextLine></TextBlock></PrintSpace></Page></Layout></alto>'
    for folder, name, data in (("alto", "p.xml", alto.encode()), ("json", "p.json", b'{"city": "rome"}'), ("images", "p.png", png(400, 500))):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / name).write_bytes(data)
    seen = {}
    at = lambda name: str(tmp_path / name)
    args = ["text", "--alto-dir", at("alto"), "--input-dir", at("json"), "--json-output-dir", "o", "--images-dir", at("images"), "--render-dir", "r"]
    runs.main(args, spark, write=lambda df, folder: seen.update({folder: df.count()}), draw=lambda df, folder: seen.update({folder: df.count()}))
    assert seen == {"o": 1, "r": 1}
