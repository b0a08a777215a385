"""Folders of files in, files or tables out: the two alignments end to end, and their command lines.

    python -m glyphgrid.plans.runs text|geometry --alto-dir A --input-dir I --json-output-dir O [options]
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphgrid.functions.text import STAGES
from glyphgrid.operators import pairing
from glyphgrid.operators.candidates import Fuzzy
from glyphgrid.operators.labels import read_mapping, require
from glyphgrid.operators.overlap import ALL, BIDIRECTIONAL, GREATEST, WORD_COVERAGE
from glyphgrid.plans.aligners import BEST, COMBINED, EXACT, ORDERED, PASS, GeometryAlignment, TextAlignment
from glyphgrid.session import materialize, materialize_counted
from glyphgrid.sinks import json_pages, label_studio, render
from glyphgrid.sources import alto, files, images, json_tree, yolo
from glyphgrid.sources import label_studio as label_studio_source

FORMATS = {json_pages.TEXT: ("json",), json_pages.GEOMETRY: ("json", "yolo", "label-studio")}
COUNTERS = ("pages", "regions", "matched", "unmatched", "ambiguous", "conflicted")
LEVELS = ("ALL", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", "OFF")


@dataclass(frozen=True)
class Run:
    """What a run found: aligned regions, documents as JSON, what had no OCR page, the counters, and the pages.

    ``pages`` and ``documents`` have ``page_ordinal``, the place of a page's file among those the run was given.
    The counters were taken while the tables were written. A text run also has all candidates, the
    ``selected`` ones, and the ambiguous and conflicted regions; a geometry run has none of these.
    """

    aligned: DataFrame
    documents: DataFrame
    unpaired: DataFrame
    summary: DataFrame
    pages: DataFrame
    candidates: DataFrame | None = None
    selected: DataFrame | None = None
    ambiguous: DataFrame | None = None
    conflicted: DataFrame | None = None


def run(spark: SparkSession, mode: str, plan: GeometryAlignment | TextAlignment, alto_files, input_files, input_format: str = "json", suffix: str | None = None, overwrite: bool = False,
        text_source: str = "json", geometry_source: str = "input", output_format: str = "package", image_prefix: str = "", fail_on_missing: bool = False, groups=(), strict: bool = True) -> Run:
    """Align folders (a path) or files (a list, in the order of the pages)."""
    require(mode in (json_pages.TEXT, json_pages.GEOMETRY), f"unknown alignment mode {mode!r}")
    require(input_format in FORMATS[mode], f"{mode} alignment does not read {input_format!r}")
    require(output_format in ("package", "label-studio"), f"unknown output format {output_format!r}")
    require(output_format == "package" or bool(image_prefix), "Label Studio output needs an image prefix")
    suffix = suffix or ("_bbox" if mode == json_pages.GEOMETRY or plan.geometry_format == "bbox" else "_polygon")
    ocr = pairing.require_unique(files.read_files(spark, alto_files, files.ALTO if isinstance(alto_files, str) else ()), "ALTO")
    inputs = files.read_files(spark, input_files, files.JSON if input_format != "yolo" and isinstance(input_files, str) else ())
    exports = None
    if input_format == "label-studio":  # pages are named by the tasks of the exports
        exports = inputs.select(F.col("path").alias("export"), F.col("content").alias("raw"))
        inputs = label_studio_source.tasks(exports).join(inputs.select("page_ordinal", F.col("path").alias("export")), "export").select("page_key", "page_ordinal", F.col("export").alias("path"), F.lit("").alias("content"))
    inputs = pairing.require_unique(inputs, "input")
    if fail_on_missing:
        pairing.require_paired(inputs, ocr)
    missing = pairing.unpaired(inputs.select("page_key", "path"), ocr)
    paired = pairing.paired(inputs, ocr.select("page_key"))
    parsed = materialize(alto.parse_pages(ocr.join(inputs.select("page_key"), "page_key", "left_semi"), strict), "alto")
    order, count = paired.select("page_key", "page_ordinal"), F.count(F.lit(1))
    pages, counts = materialize_counted(alto.pages(parsed).join(order, "page_key"), "pages", pages=count)
    docs = paired.select("page_key", "page_ordinal", F.col("content").alias("raw"))
    if input_format == "yolo":
        regions = yolo.detections(yolo.lines_of(paired), strict)
        require(yolo.category_conflicts(regions).isEmpty(), "category ids and names must belong together, in a file and across files")
        regions = yolo.deduplicated(regions, groups)
    elif input_format == "label-studio":
        regions = label_studio_source.regions(exports, strict).join(paired.select("page_key"), "page_key", "left_semi")
    elif mode == json_pages.TEXT:
        regions = json_tree.text_regions(docs, suffix, overwrite, strict=strict)
    else:
        regions = json_tree.geometry_regions(docs, suffix, overwrite, strict)
    for name, kind in (("category_id", "int"), ("confidence", "double"), ("input_text", "string"), ("text_path", json_tree.PATH), ("geometry_path", json_tree.PATH)):
        if name not in regions.columns:
            regions = regions.withColumn(name, F.lit(None).cast(kind))
    regions = materialize(pairing.require_unique_regions(regions.filter("region_id IS NOT NULL")), "regions")
    found_by: tuple[DataFrame, ...] = ()
    if mode == json_pages.TEXT:
        aligned, candidates, chosen = plan.align_with_candidates(regions, alto.words(parsed))
        (ambiguous, some), (conflicted, others) = (materialize_counted(df, n, **{n: count}) for n, df in zip(("ambiguous", "conflicted"), plan.diagnostics(candidates, chosen), strict=True))
        counts |= some | others
        found_by = (candidates, chosen, ambiguous, conflicted)
    else:
        aligned = plan.align(regions, alto.words(parsed))
    aligned, some = materialize_counted(aligned, "aligned", regions=count, matched=F.count_if(F.col("words").isNotNull()))
    counts |= some
    counts["unmatched"] = counts["regions"] - counts["matched"]
    summary = spark.createDataFrame([tuple(counts.get(c, 0) for c in COUNTERS)], ", ".join(f"{c} long" for c in COUNTERS))
    if output_format == "label-studio":
        found = label_studio.results(aligned, pages, mode, text_source, geometry_source)
        documents = label_studio.documents(found, pages, image_prefix)
    elif input_format == "json":
        documents = json_pages.filled_documents(docs, aligned, mode, suffix, plan.geometry_format, text_source, geometry_source)
    else:
        documents = json_pages.grouped_documents(aligned, plan.geometry_format, geometry_source)
    return Run(aligned, documents.join(order, "page_key"), missing, summary, pages, *found_by)


def with_images(found: Run, images: DataFrame, mode: str, fmt: str = "bbox", text_source: str = "json", geometry_source: str = "input") -> DataFrame:
    """The render plan over images (page_key, image_width, image_height); pages without an image are left out."""
    return render.render_plan(found.aligned, found.pages.join(images, "page_key"), mode, fmt, text_source, geometry_source)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="glyphgrid")
    modes = top.add_subparsers(dest="mode", required=True)
    for mode in (json_pages.TEXT, json_pages.GEOMETRY):
        p = modes.add_parser(mode)
        for name in ("--alto-dir", "--input-dir", "--json-output-dir"):
            p.add_argument(name, required=True)
        p.add_argument("--input-format", choices=FORMATS[mode], default="json")
        p.add_argument("--output-json-format", choices=("package", "label-studio"), default="package")
        p.add_argument("--label-studio-image-prefix", default="")
        p.add_argument("--class-mapping-file")
        p.add_argument("--output-alto-text-format", choices=("space-separated",), default="space-separated")
        p.add_argument("--output-alto-geometry-format", choices=("bbox", "polygon"), default="bbox")
        p.add_argument("--images-dir")
        p.add_argument("--render-dir")
        p.add_argument("--fail-on-missing-alto", action="store_true")
        p.add_argument("--geometry-suffix")
        p.add_argument("--logging-level", type=str.upper, choices=LEVELS, default="WARN")
        if mode == "text":
            p.add_argument("--output-text-source", choices=("json", "alto"), default="json")
            p.add_argument("--text-normalizer", action="append", choices=tuple(STAGES), default=[])
            p.add_argument("--candidate-generator", choices=(EXACT, COMBINED, ORDERED), default=COMBINED)
            p.add_argument("--candidate-selector", choices=(BEST, PASS), default=BEST)
            p.add_argument("--fuzzy-query-length-boundary", type=int, default=6)
            p.add_argument("--fuzzy-max-cer-at-or-above-boundary", type=float, default=0.20)
            p.add_argument("--fuzzy-max-edit-distance-below-boundary", type=int, default=1)
            p.add_argument("--fuzzy-max-candidates-per-value", type=int, default=5)
            p.add_argument("--solver-time-limit-seconds", type=float)
            p.add_argument("--overwrite-existing-geometry", action="store_true")
        else:
            p.add_argument("--minimum-overlap-coverage", type=float, default=0.65)
            p.add_argument("--overlap-strategy", choices=(BIDIRECTIONAL, WORD_COVERAGE), default=BIDIRECTIONAL)
            p.add_argument("--word-assignment-strategy", choices=(GREATEST, ALL), default=GREATEST)
            p.add_argument("--output-geometry-source", choices=("input", "alto"), default="input")
            p.add_argument("--overwrite-existing-text", action="store_true")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None, write: Callable[[DataFrame, str], object] = json_pages.write_pages, draw: Callable[[DataFrame, str], object] | None = None) -> Run:
    """The command line. ``write`` takes the documents and the output folder, ``draw`` the render plan and the folder for drawings (the plan is written as JSON lines)."""
    top = parser()
    a = top.parse_args(argv)
    if a.output_json_format == "label-studio" and not a.label_studio_image_prefix:
        top.error("--label-studio-image-prefix is needed for label-studio output")
    if bool(a.images_dir) != bool(a.render_dir):
        top.error("--images-dir and --render-dir go together")
    spark = spark or SparkSession.builder.appName("glyphgrid").getOrCreate()
    spark.sparkContext.setLogLevel(a.logging_level)
    mapping = read_mapping(spark, a.class_mapping_file) if a.class_mapping_file else None
    common = {"suffix": a.geometry_suffix, "output_format": a.output_json_format, "image_prefix": a.label_studio_image_prefix, "fail_on_missing": a.fail_on_missing_alto}
    if a.mode == json_pages.TEXT:
        fuzzy = Fuzzy(a.fuzzy_query_length_boundary, a.fuzzy_max_cer_at_or_above_boundary, a.fuzzy_max_edit_distance_below_boundary, a.fuzzy_max_candidates_per_value)
        plan = TextAlignment(a.candidate_generator, a.candidate_selector, tuple(a.text_normalizer), fuzzy, a.output_alto_geometry_format, mapping, a.solver_time_limit_seconds)
        found = run(spark, a.mode, plan, a.alto_dir, a.input_dir, "json", overwrite=a.overwrite_existing_geometry, text_source=a.output_text_source, **common)
    else:
        plan = GeometryAlignment(a.minimum_overlap_coverage, a.overlap_strategy, a.word_assignment_strategy, a.output_alto_geometry_format, mapping)
        found = run(spark, a.mode, plan, a.alto_dir, a.input_dir, a.input_format, overwrite=a.overwrite_existing_text, geometry_source=a.output_geometry_source, **common)
    write(found.documents, a.json_output_dir)
    if a.render_dir:  # the plan of what to draw; drawing itself needs an imaging library
        sizes = images.sizes(files.read_files(spark, a.images_dir, files.IMAGES, text=False)).drop("path")
        plan_ = with_images(found, sizes, a.mode, a.output_alto_geometry_format)
        draw(plan_, a.render_dir) if draw else plan_.write.mode("overwrite").json(a.render_dir)
    found.summary.show()
    return found


if __name__ == "__main__":
    main()
