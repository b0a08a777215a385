"""Session helpers shared by the operators."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Where materialised frames lie, so that they can be removed once nothing reads them.
_written: WeakKeyDictionary = WeakKeyDictionary()
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Whether both sides of a join are exchanged again if they are dealt by some of its columns only.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
#: Parts that pages are dealt to, for each partition a shuffle has: a text is few bytes, but much once its words are laid out.
PARTS = 4
#: At least as many parts of pages for each part of the files they are read from, so that a part stays as small however much is read.
PARTS_READ = 8
#: Bytes of an Arrow batch of texts, beyond which it is closed whatever its rows.
BATCH_BYTES = 32 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; any path that Spark's own readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on this machine alone (tests) a
    temporary folder is taken and set; on a cluster it is an error, as every
    executor would write to a folder of its own.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="glyphgrid-")
        sc.setCheckpointDir(configured)
    return configured.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/glyphgrid/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` once to the shared folder and read it back.

    Later branches then read a small Parquet table instead of computing the
    branch again, and a lost executor costs only its own tasks.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    with shuffles_removed(spark):
        df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    _written[read] = path
    return read


def materialize_counted(df: DataFrame, label: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """:func:`materialize`, and what was counted (aggregates) while the rows were written; nothing is read for it again."""
    seen = Observation()
    written = materialize(df.observe(seen, *(c.alias(n) for n, c in counts.items())), label)
    return written, {n: seen.get.get(n) or 0 for n in counts}


def tasks(spark: SparkSession) -> int:
    """The number of partitions a shuffle has; given outright, partitions of few bytes but much work are not folded together."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes inside leave no shuffle files behind when they are done; else these stay until the driver collects its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def discard(*frames: DataFrame) -> None:
    """Remove what :func:`materialize` wrote for these frames, once all that reads them is written itself."""
    for df in frames:
        path = _written.pop(df, None)
        if path is not None:
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of any store Spark writes to."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound the Arrow batches sent to Python where rows carry whole texts, by rows and by bytes."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        said = spark.conf.get(key).removesuffix("b")
        if not said.isdigit() or not 0 < int(said) <= most:
            spark.conf.set(key, str(most))


def slices(batches: Iterator, rows: int = 256) -> Iterator:
    """Arrow batches a few rows at a time, where what is made of whole texts takes many times their room.

    Spark itself closes a batch by its bytes (``spark.sql.execution.arrow.maxBytesPerBatch``).
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def page_parts(spark: SparkSession) -> int:
    """The number of parts that pages lie in, or a divisor of it."""
    return PARTS * tasks(spark)


def dealt_by_page(pages: DataFrame) -> DataFrame:
    """``pages``, made row by row of what is read, exchanged by page, once for all that follows.

    Joins, windows and groups by page and more columns stay where the page is. For this the
    session no longer has joins ask for sides dealt by all their columns, for good.
    """
    spark, parts = pages.sparkSession, page_parts(pages.sparkSession)
    spark.conf.set(ALL_KEYS, "false")
    return pages.repartition(parts * max(1, math.ceil(PARTS_READ * pages.rdd.getNumPartitions() / parts)), "page_key")


def materialize_by_page(df: DataFrame, label: str) -> DataFrame:
    """:func:`materialize` in buckets of pages, so that what follows by page needs no exchange of it; ``df`` should lie by page."""
    spark = df.sparkSession
    name, path = f"glyphgrid_{uuid.uuid4().hex}", new_path(spark, label)
    spark.conf.set(ALL_KEYS, "false")
    with shuffles_removed(spark):
        df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(page_parts(spark), "page_key").saveAsTable(name)
    read = spark.table(name)
    _written[read] = path
    return read
