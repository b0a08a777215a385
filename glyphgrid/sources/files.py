"""Files of a folder, and the page each belongs to."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALTO, JSON, IMAGES = (".xml",), (".json",), (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp", ".webp")


def page_key(path: str) -> str:
    """A file's name without its last suffix."""
    return PurePosixPath(path).stem


def page_key_of(path: Column) -> Column:
    """The same as a column; a name that only begins with a point keeps it."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.rlike(r"^\.[^.]*$|\.$"), name).otherwise(F.regexp_replace(name, r"(.)\.[^.]*$", "$1"))


def qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark's readers name it."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(there).toString()


def read_files(spark: SparkSession, paths: str | Sequence[str], suffixes: Sequence[str] = (), text: bool = True) -> DataFrame:
    """(page_key, page_ordinal, path, content): the top level of a folder, or files in the given order.

    Suffixes are compared in lower case; none given: every file. The pages of a
    folder are in the order of their paths and have no ordinal.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(listed).select("path", "content")
    if suffixes:
        found = found.filter(F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
    if isinstance(paths, str):
        found = found.withColumn("page_ordinal", F.lit(None).cast("int"))
    else:
        # as many rows as the caller has named files
        order = spark.createDataFrame([(qualified(spark, p), k) for k, p in enumerate(listed)], "path string, page_ordinal int")
        found = found.join(F.broadcast(order), "path")
    content = F.decode("content", "UTF-8") if text else F.col("content")
    return found.select(page_key_of(F.col("path")).alias("page_key"), "page_ordinal", "path", content.alias("content"))
