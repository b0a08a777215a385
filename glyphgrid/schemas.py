"""Column types shared by sources, operators and sinks."""

from __future__ import annotations

BOX = "struct<x:double,y:double,width:double,height:double>"
POINTS = "array<struct<x:double,y:double>>"
PATH = "array<struct<key:string,idx:int>>"

PAGES = "page_key string, alto_file_path string, alto_page_id string, alto_width double, alto_height double"
WORDS = "page_key string, word_index int, text string, x double, y double, width double, height double, line_index int, block_index int, element_id string"
REGIONS = (
    "page_key string, region_id int, label string, input_text string, input_text_type string, "
    f"bbox {BOX}, polygon {POINTS}, category_id int, confidence double, text_path {PATH}, geometry_path {PATH}"
)
#: Fixed-point scale of the error and similarity rates.
SCALE = 1_000_000
