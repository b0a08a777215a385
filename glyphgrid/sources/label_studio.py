"""Label Studio project exports: rectangles of the newest annotation that was not cancelled."""

from __future__ import annotations

from urllib.parse import parse_qs, unquote, urlparse

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphgrid.functions import geometry as G
from glyphgrid.schemas import PATH
from glyphgrid.sources.files import page_key

RESULTS = (
    "array<struct<type:string,original_width:double,original_height:double,image_rotation:double,"
    "value:struct<x:double,y:double,width:double,height:double,rotation:double,rectanglelabels:array<string>>>>"
)
ANNOTATIONS = f"array<struct<was_cancelled:boolean,created_at:string,updated_at:string,result:{RESULTS}>>"
TASKS = f"array<struct<id:bigint,data:struct<image:string>,annotations:{ANNOTATIONS}>>"


def key_of_image(reference: str | None) -> str | None:
    """The page an image reference names: its ``d`` parameter or else its path, without folder and suffix."""
    if not reference or not reference.strip():
        return None
    url = urlparse(reference)
    named = parse_qs(url.query).get("d", [""])[0]
    return page_key(unquote(named or url.path)) or None


@F.pandas_udf(T.StringType())
def page_key_of_image(images):
    return images.map(key_of_image)


def tasks(exports: DataFrame) -> DataFrame:
    """(export, task_index, page_key, annotations) of exports (export, raw: a JSON array); an image without a name is an error."""
    read = exports.select("export", F.posexplode(F.from_json("raw", TASKS)).alias("task_index", "task"))
    named = read.select("export", "task_index", page_key_of_image(F.col("task.data.image")).alias("page_key"), F.coalesce("task.annotations", F.array().cast(ANNOTATIONS)).alias("annotations"))
    fail = F.raise_error(F.concat(F.lit("no page key in the image of task "), F.col("task_index").cast("string")))
    return named.withColumn("page_key", F.coalesce("page_key", fail.cast("string")))


def duplicate_pages(found: DataFrame) -> DataFrame:
    return found.groupBy("export", "page_key").agg(F.count("*").alias("n")).filter("n > 1")


def one_task_a_page(found: DataFrame) -> DataFrame:
    """The tasks, or an error if two of an export name one page (checked as they are read)."""
    of_page = Window.partitionBy("export", "page_key")
    fail = F.raise_error(F.concat(F.lit("more than one task for page "), "page_key")).cast("boolean")
    return found.withColumn("alone", F.when(F.count("*").over(of_page) > 1, fail).otherwise(F.lit(True))).filter("alone").drop("alone")


def newest(found: DataFrame) -> DataFrame:
    """The annotation of each task by time of update (or creation), creation, place; no time is earliest."""
    time = lambda c: F.coalesce(c.try_cast("timestamp").cast("double"), F.lit(float("-inf")))
    ranked = F.transform("annotations", lambda a, k: F.struct(time(F.coalesce(a["updated_at"], a["created_at"])).alias("updated"), time(a["created_at"]).alias("created"), k.alias("k"), F.coalesce(a["was_cancelled"], F.lit(False)).alias("gone")))
    best = F.array_max(F.transform(F.filter(ranked, lambda a: ~a["gone"]), lambda a: F.struct(a["updated"].alias("updated"), a["created"].alias("created"), a["k"].alias("k"))))
    return found.withColumn("best", best).filter("best IS NOT NULL").select("export", "task_index", "page_key", F.col("best.k").alias("annotation_index"), F.get("annotations", F.col("best.k"))["result"].alias("result"))


def regions(exports: DataFrame, strict: bool = True) -> DataFrame:
    """Rectangles in pixels, numbered as they stand; rotated or ill-formed ones are an error (or have ``error``). Two tasks of a page always are."""
    each = newest(one_task_a_page(tasks(exports))).select("export", "task_index", "page_key", "annotation_index", F.posexplode("result").alias("result_index", "r")).filter("r.type = 'rectanglelabels'")
    v = F.col("r.value")
    positive = lambda c: F.coalesce(G.finite(c) & (c > 0), F.lit(False))
    labels = v["rectanglelabels"]
    error = (
        F.when(v.isNull(), "a rectangle needs a value")
        .when(labels.isNull() | (F.size(labels) != 1) | F.coalesce(F.get(labels, F.lit(0)) == "", F.lit(True)), "a rectangle needs one label")
        .when((F.coalesce(v["rotation"], F.lit(0.0)) != 0) | (F.coalesce(F.col("r.image_rotation"), F.lit(0.0)) != 0), "rotated rectangles are not supported")
        .when(~positive(F.col("r.original_width")) | ~positive(F.col("r.original_height")), "original sizes must be positive")
        .when(~positive(v["width"]) | ~positive(v["height"]) | ~F.coalesce(G.finite(v["x"]) & G.finite(v["y"]), F.lit(False)), "the rectangle must be finite and positive")
    )
    each = each.withColumn("error", error)
    if strict:
        fail = F.raise_error(F.concat(F.lit("page "), "page_key", F.lit(": "), "error")).cast("string")
        each = each.withColumn("error", F.when(F.col("error").isNotNull(), fail)).filter("error IS NULL")
    order = Window.partitionBy("export", "task_index").orderBy("result_index")
    key = lambda x: F.struct(F.lit(x).alias("key"), F.lit(None).cast("int").alias("idx"))
    idx = lambda c: F.struct(F.lit(None).cast("string").alias("key"), c.cast("int").alias("idx"))
    path = F.array(idx(F.col("task_index")), key("annotations"), idx(F.col("annotation_index")), key("result"), idx(F.col("result_index")), key("value")).cast(PATH)
    return each.select(
        "page_key", (F.row_number().over(order) - 1).cast("int").alias("region_id"), F.get(labels, F.lit(0)).alias("label"),
        G.from_percent(v, F.col("r.original_width"), F.col("r.original_height")).alias("bbox"), path.alias("geometry_path"), "error",
    )
