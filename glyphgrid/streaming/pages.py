"""Pages aligned as their files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphgrid.plans.aligners import GeometryAlignment
from glyphgrid.sources import alto, files


def alto_stream(spark: SparkSession, folder: str, files_a_trigger: int = 1000) -> DataFrame:
    """(page_key, path, content) of ALTO files as they appear in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    read = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.xml").option("maxFilesPerTrigger", files_a_trigger).load(folder)
    return read.select(files.page_key_of(F.col("path")).alias("page_key"), "path", F.decode("content", "UTF-8").alias("content"))


def align_arriving(spark: SparkSession, folder: str, regions: DataFrame, output: str, checkpoint: str, plan: GeometryAlignment | None = None) -> StreamingQuery:
    """Each batch of pages aligned with its regions and written below ``output`` by batch number, so that a repeated batch writes the same files."""
    plan = plan or GeometryAlignment()

    def batch(df: DataFrame, number: int) -> None:
        words = alto.words(alto.parse_pages(df, strict=False).filter("error IS NULL"))
        own = regions.join(df.select("page_key"), "page_key", "left_semi")
        plan.align(own, words).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return alto_stream(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
