"""Pages of an input paired with OCR pages and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphgrid.operators.labels import require


def duplicate_keys(pages: DataFrame) -> DataFrame:
    return pages.groupBy("page_key").agg(F.count("*").alias("n")).filter("n > 1")


def require_unique(pages: DataFrame, side: str) -> DataFrame:
    """The pages, or an error if two have one key (checked as they are read)."""
    twice = duplicate_keys(pages).select("page_key", F.raise_error(F.concat(F.lit(f"more than one {side} file for page "), "page_key")).cast("boolean").alias("twice"))
    return pages.join(twice, "page_key", "left").filter("twice IS NULL").drop("twice")


def require_unique_regions(regions: DataFrame) -> DataFrame:
    """The regions, or an error if two of a page have one id (checked as they are read)."""
    n = F.count("*").over(Window.partitionBy("page_key", "region_id"))
    twice = F.raise_error(F.concat(F.lit("more than one region "), F.col("region_id").cast("string"), F.lit(" on page "), "page_key")).cast("boolean")
    return regions.withColumn("regions_of_id", n).filter(F.when(F.col("regions_of_id") > 1, twice).otherwise(F.lit(True))).drop("regions_of_id")


def paired(inputs: DataFrame, alto: DataFrame) -> DataFrame:
    """Inputs that have an OCR page, with its columns."""
    return inputs.join(alto, "page_key")


def unpaired(inputs: DataFrame, alto: DataFrame) -> DataFrame:
    return inputs.join(alto.select("page_key"), "page_key", "left_anti")


def require_paired(inputs: DataFrame, alto: DataFrame) -> None:
    missing = [r["page_key"] for r in unpaired(inputs, alto).select("page_key").orderBy("page_key").limit(5).collect()]
    require(not missing, f"no ALTO file for pages {missing}")


def with_images(pages: DataFrame, images: DataFrame) -> DataFrame:
    return pages.join(images.select("page_key", F.col("path").alias("image_path")), "page_key", "left")


def match_counts(aligned: DataFrame) -> DataFrame:
    """(page_key, regions, matched, unmatched): a region is matched if it has words, and so a score; the words themselves need not be gathered."""
    matched = F.count_if(F.col("alignment_score").isNotNull())
    return aligned.groupBy("page_key").agg(F.count("*").alias("regions"), matched.alias("matched"), (F.count("*") - matched).alias("unmatched"))


def run_summary(aligned: DataFrame, ambiguous: DataFrame | None = None, conflicted: DataFrame | None = None) -> DataFrame:
    """One row: pages, regions, matched, unmatched, ambiguous and conflicted."""
    total = match_counts(aligned).agg(F.count("*").alias("pages"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("regions", "matched", "unmatched")))
    for name, df in (("ambiguous", ambiguous), ("conflicted", conflicted)):
        one = df.agg(F.count("*").alias(name)) if df is not None else None
        total = total.crossJoin(one) if one is not None else total.withColumn(name, F.lit(0).cast("long"))
    return total
