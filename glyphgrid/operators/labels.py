"""Label mapping, and the check of options."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def require(holds: bool, message: str) -> None:
    if not holds:
        raise ValueError(message)


def checked_mapping(mapping: dict) -> dict[str, str]:
    """A mapping of non-blank strings to non-blank strings, or an error."""
    if not isinstance(mapping, dict):
        raise TypeError("label mapping must be an object")
    for key, value in mapping.items():
        if not isinstance(key, str) or not isinstance(value, str):
            raise TypeError("label mapping must map strings to strings")
        require(bool(key.strip()) and bool(value.strip()), "labels must not be blank")
    return dict(mapping)


def read_mapping(spark: SparkSession, path: str) -> dict[str, str]:
    """The mapping of a small JSON file, through Spark's reader; a repeated key is an error."""

    def unique(pairs: list[tuple[str, object]]) -> dict:
        require(len({k for k, _ in pairs}) == len(pairs), "label mapping repeats a key")
        return dict(pairs)

    text = spark.read.text(path, wholetext=True).first()["value"]
    return checked_mapping(json.loads(text, object_pairs_hook=unique))


def mapped(regions: DataFrame, mapping: dict[str, str] | None) -> DataFrame:
    """``label_export``: what the label maps to, in one step; null where it maps to nothing."""
    if not mapping:
        return regions.withColumn("label_export", F.lit(None).cast("string"))
    lookup = F.create_map(*(F.lit(x) for pair in checked_mapping(mapping).items() for x in pair))
    return regions.withColumn("label_export", F.try_element_at(lookup, F.col("label")))


def export_label() -> F.Column:
    return F.coalesce(F.col("label_export"), F.col("label"))
