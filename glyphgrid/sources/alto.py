"""ALTO XML pages: words in document order with their line and block."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphgrid.session import small_batches

NEEDED = ("CONTENT", "HPOS", "VPOS", "WIDTH", "HEIGHT")
#: Words, as Python objects, after which those of the pages so far go on to Spark.
HELD = 20_000
PARSED = (
    "page_key string, path string, error string, page_id string, page_width double, page_height double, "
    "words array<struct<word_index:int,text:string,x:double,y:double,width:double,height:double,line_index:int,block_index:int,element_id:string>>"
)


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def parse(content: str | bytes) -> tuple:
    """(page id, width, height, words) of a document; the page is the first, the words are those of all pages."""
    try:
        root = ElementTree.fromstring(content)
    except ElementTree.ParseError as e:
        raise ValueError(f"invalid ALTO XML: {e}") from e
    page = next((e for e in root.iter() if local(e.tag) == "Page"), None)
    number = lambda name: float(page.attrib[name]) if page is not None and name in page.attrib else None
    words: list[tuple] = []
    counts = {"TextBlock": -1, "TextLine": -1}
    todo: list[tuple] = [(root, None, None)]
    while todo:
        element, block, line = todo.pop()
        name = local(element.tag)
        if name in counts:
            counts[name] += 1
            block, line = (counts[name], line) if name == "TextBlock" else (block, counts[name])
        elif name == "String":
            missing = [a for a in NEEDED if a not in element.attrib]
            if missing:
                raise ValueError(f"ALTO String lacks {missing}")
            text, *place = (element.attrib[a] for a in NEEDED)
            words.append((len(words), text, *map(float, place), line, block, element.attrib.get("ID")))
        todo.extend((child, block, line) for child in reversed(element))
    return (page.attrib.get("ID") if page is not None else None), number("WIDTH"), number("HEIGHT"), words


def parsed_frames(frames: Iterator, strict: bool = True) -> Iterator:
    """Frames of ``PARSED``, closed when their pages hold ``HELD`` words, however many files come at once."""
    import pandas as pd

    names = ("word_index", "text", "x", "y", "width", "height", "line_index", "block_index", "element_id")
    frame = lambda rows: pd.DataFrame(rows, columns=["page_key", "path", "error", "page_id", "page_width", "page_height", "words"])
    rows, held = [], 0
    for pdf in frames:
        for key, path, content in pdf[["page_key", "path", "content"]].itertuples(index=False):
            try:
                page_id, width, height, words = parse(content)
                rows.append((key, path, None, page_id, width, height, [dict(zip(names, w, strict=True)) for w in words]))
                held += len(words)
            except ValueError as e:
                if strict:
                    raise ValueError(f"{path}: {e}") from e
                rows.append((key, path, str(e), None, None, None, []))
            if held >= HELD:
                yield frame(rows)
                rows, held = [], 0
    if rows:
        yield frame(rows)


def parse_pages(files: DataFrame, strict: bool = True) -> DataFrame:
    """One row a file with its words; what is wrong with a file is an error, or (not strict) the column ``error``."""
    small_batches(files.sparkSession)
    return files.select("page_key", "path", "content").mapInPandas(lambda frames: parsed_frames(frames, strict), PARSED)


def pages(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_key", F.col("path").alias("alto_file_path"), F.col("page_id").alias("alto_page_id"), F.col("page_width").alias("alto_width"), F.col("page_height").alias("alto_height"))


def words(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_key", F.explode("words").alias("w")).select("page_key", "w.*")
