"""The two alignments as plans over DataFrames."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphgrid.functions import geometry as G
from glyphgrid.functions.text import normaliser
from glyphgrid.operators import select as S
from glyphgrid.operators.build import WORD, joined_text, matched_words, union_box, with_alto
from glyphgrid.operators.candidates import Fuzzy, exact_and_fuzzy, exact_candidates
from glyphgrid.operators.labels import mapped, require
from glyphgrid.operators.ordered import ordered_candidates
from glyphgrid.operators.orthogonal import orthogonal_polygon
from glyphgrid.operators.overlap import BIDIRECTIONAL, GREATEST, assigned, overlaps
from glyphgrid.operators.textindex import index_words
from glyphgrid.schemas import SCALE
from glyphgrid.session import materialize

EXACT, COMBINED, ORDERED = "exact", "combined", "ordered-alignment"
BEST, PASS = "cp-sat", "pass-through"


@dataclass(frozen=True)
class GeometryAlignment:
    """Boxes and polygons take the text of the words they cover.

    A strategy, an assignment, the text and the geometry of matched words may
    each be a function instead of a name: of (regions, words), of the overlaps,
    and of the column of words.
    """

    minimum: float = 0.65
    strategy: str | Callable[[DataFrame, DataFrame], DataFrame] = BIDIRECTIONAL
    assignment: str | Callable[[DataFrame], DataFrame] = GREATEST
    geometry_format: str = "bbox"
    mapping: dict[str, str] | None = None
    polygons: bool = True
    text: Callable[[Column], Column] = joined_text
    outline: Callable[[Column], Column] = orthogonal_polygon
    box: Callable[[Column], Column] = union_box

    def align(self, regions: DataFrame, words: DataFrame) -> DataFrame:
        """``regions`` with words, alignment_score, alto_text, alto_bbox, alto_polygon, quality_issues; unmatched ones with nulls."""
        if "polygon" not in regions.columns:
            regions = regions.withColumn("polygon", F.lit(None).cast("array<struct<x:double,y:double>>"))
        named = mapped(regions, self.mapping).withColumn("quality_issues", G.quality_issues(F.col("bbox"), F.col("polygon")))
        met = self.strategy(named, words) if callable(self.strategy) else overlaps(named, words, self.minimum, self.strategy, polygons=self.polygons, carried=WORD[1:])
        found = self.assignment(met) if callable(self.assignment) else assigned(met, self.assignment)
        return with_alto(named.join(matched_words(found, words), ["page_key", "region_id"], "left"), self.geometry_format, self.text, self.outline, self.box)


@dataclass(frozen=True)
class TextAlignment:
    """Text values take the geometry of the words that spell them.

    Generator, selector, and the text and the geometry of matched words may each
    be a function instead of a name: of (values, index), of the candidates, and
    of the column of words. ``by_page``: the words lie by page already. ``time_limit`` bounds the search for the best choice
    (seconds for each independent part); what is not known to be the best by then
    is an error, or with ``require_optimal`` false the best found.
    """

    generator: str | Callable[[DataFrame, DataFrame], DataFrame] = COMBINED
    selector: str | Callable[[DataFrame], DataFrame] = BEST
    normalizers: Sequence[str] = ()
    fuzzy: Fuzzy = field(default_factory=Fuzzy)
    geometry_format: str = "bbox"
    mapping: dict[str, str] | None = None
    time_limit: float | None = None
    require_optimal: bool = True
    normalise: Callable | None = None
    text: Callable[[Column], Column] = joined_text
    outline: Callable[[Column], Column] = orthogonal_polygon
    box: Callable[[Column], Column] = union_box
    by_page: bool = False

    def __post_init__(self):
        require(callable(self.generator) or self.generator in (EXACT, COMBINED, ORDERED), f"unknown candidate generator {self.generator!r}")
        require(callable(self.selector) or self.selector in (BEST, PASS), f"unknown candidate selector {self.selector!r}")
        if self.fuzzy.has_cliff:
            warnings.warn(f"values of {self.fuzzy.length_boundary} characters may have fewer edits than shorter ones: rate {self.fuzzy.max_cer}, edits {self.fuzzy.max_edits}", stacklevel=3)

    def index(self, words: DataFrame) -> DataFrame:
        return index_words(words, self.normalise or normaliser(self.normalizers), self.by_page)

    def values(self, regions: DataFrame) -> DataFrame:
        norm = (self.normalise or normaliser(self.normalizers))(F.col("input_text"))
        return regions.select("page_key", "region_id", "input_text", norm.alias("norm"))

    def candidates(self, values: DataFrame, index: DataFrame) -> DataFrame:
        if callable(self.generator):
            return self.generator(values, index)
        if self.generator == ORDERED:
            return ordered_candidates(values, index, self.fuzzy.length_boundary, self.fuzzy.max_cer, self.fuzzy.max_edits)
        return exact_candidates(values, index) if self.generator == EXACT else exact_and_fuzzy(values, index, self.fuzzy)

    def chosen(self, candidates: DataFrame) -> DataFrame:
        if callable(self.selector):
            return self.selector(candidates)
        return S.selected(candidates, self.time_limit, self.require_optimal) if self.selector == BEST else S.passed_through(candidates)

    def align(self, regions: DataFrame, words: DataFrame, pages: DataFrame | None = None) -> DataFrame:
        """``regions`` with the chosen candidate, its words, text and geometry; unmatched ones with nulls.

        ``pages``: the index of the words as one row a page, if it is at hand (not for the ordered alignment).
        """
        return self.align_with_candidates(regions, words, pages)[0]

    def align_with_candidates(self, regions: DataFrame, words: DataFrame, pages: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """What :meth:`align` gives, all candidates, and those the selector chose, for :meth:`diagnostics`."""
        # the index is gathered by page at once; written, it would be exchanged again
        index, values = self.index(words) if pages is None else pages, materialize(self.values(regions), "values")
        candidates = materialize(self.candidates(values, index), "candidates")
        selected = materialize(self.chosen(candidates), "selected")
        chosen = S.last_of_region(selected)
        spans = chosen.select("page_key", "region_id", "candidate_id", "source", F.col("normalized_matched_text").alias("alto_text_normalized"), (F.col("similarity_int") / SCALE).alias("alignment_score"), "start_word", "end_word")
        each = spans.select("page_key", "region_id", F.explode(F.sequence("start_word", "end_word")).alias("word_index"))
        lists = each.join(words.select("page_key", *WORD), ["page_key", "word_index"]).groupBy("page_key", "region_id").agg(F.array_sort(F.collect_list(F.struct(*WORD))).alias("words"))
        named = mapped(regions, self.mapping).join(values.select("page_key", "region_id", F.col("norm").alias("input_text_normalized")), ["page_key", "region_id"], "left")
        return with_alto(named.join(spans, ["page_key", "region_id"], "left").join(lists, ["page_key", "region_id"], "left"), self.geometry_format, self.text, self.outline, self.box), candidates, selected

    def diagnostics(self, candidates: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Ambiguous and conflicted regions."""
        return S.ambiguous(candidates), S.conflicted(candidates, chosen)
