"""Exact deduplication by content-defined chunk recipes; DataFrame functions only.

A text is cut where its content says so (after a full stop or line end, within
bounds on the length), so equal texts have equal chunk lists and a chunk that
moved inside a long document is still the same chunk. Chunks are deduplicated
to identifiers, which are verified: every identifier is checked to stand for
one content. A document then is its recipe, the ordered list of identifiers,
and only recipes are compared and moved.

Defined results: null counts as empty, and all empty texts are one group. Of
equal texts one row with the largest id stays, whichever if rows repeat it.
Null ids are smaller than all others. An empty table gives an
empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphgrid.llm.columns import unused
from glyphgrid.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bounds on a chunk's length, in characters.
SHORTEST, LONGEST = 256, 4096
#: Rows of a group of equal texts meet in so many parts first.
SALTS = 32


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; ``lower`` does just that where all characters are ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def chunks(text: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """The text as an array of chunks that, joined, are the text."""
    pattern = rf"(?s).{{{shortest},{longest - 1}}}?[.\n]|.{{1,{longest}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def identifier(chunk: Column, bits: int = 64) -> Column:
    full = F.xxhash64(chunk)
    return full if bits == 64 else F.pmod(full, F.lit(2**bits))


def distinct_chunks(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(h, chunk) of every different chunk, formed before anything is shuffled, so a chunk moves once for each task that met it."""
    return docs.select(F.explode(chunks(F.col("norm"))).alias("chunk")).select(identifier(F.col("chunk"), bits).alias("h"), "chunk").distinct()


def collisions(docs: DataFrame, bits: int = 64) -> DataFrame:
    """Identifiers that stand for more than one content; only they are moved and written."""
    return materialize(distinct_chunks(docs, bits).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "chunk-clashes")


def recipes(docs: DataFrame, bits: int = 64) -> DataFrame:
    """``docs`` (with ``norm``) with ``recipe``, the ordered verified identifiers.

    Almost always no identifier is shared and it alone is enough. Otherwise each
    content of the shared ones has a digest that follows it in the recipe.
    """
    parts = F.transform(chunks(F.col("norm")), lambda c: identifier(c, bits))
    clash = collisions(docs, bits)
    if clash.isEmpty():
        return docs.withColumn("recipe", parts)
    plain = docs.withColumn("recipe", F.transform(parts, lambda h: F.struct(h.alias("h"), F.lit("").alias("digest"))))
    # rows are numbered once, in what is written
    keyed = materialize(plain.withColumn("number", F.monotonically_increasing_id()), "numbered")
    found = (
        keyed.select("number", F.posexplode(chunks(F.col("norm"))).alias("at", "chunk"))
        .withColumn("h", identifier(F.col("chunk"), bits))
        .join(clash, "h")
        .groupBy("number")
        .agg(F.map_from_entries(F.collect_list(F.struct("at", F.sha2("chunk", 256).alias("digest")))).alias("digests"))
    )
    verified = F.transform(F.col("recipe"), lambda x, i: F.struct(x["h"].alias("h"), F.coalesce(F.element_at(F.col("digests"), i), F.lit("")).alias("digest")))
    return keyed.join(found, "number", "left").withColumn("recipe", F.when(F.col("digests").isNull(), F.col("recipe")).otherwise(verified)).drop("number", "digests")


def exact_duplicates(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    A group may hold a third of all rows: its rows meet in ``SALTS`` parts, the
    parts' sums meet next, and the answer goes back the same way.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ascii_lower(text).alias("norm"))
    sha = F.unhex(F.sha2("norm", 256)).alias("sha")
    rows = materialize(recipes(base, bits).select(F.monotonically_increasing_id().alias("row"), "doc_id", sha, "recipe", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")), "recipes")
    id_ = lambda name: F.coalesce(F.col(name), F.lit(-(2**63)))
    parts = rows.groupBy("recipe", "salt").agg(F.max("doc_id").alias("keep_id"), F.max_by("row", id_("doc_id")).alias("keep_row"), F.count("*").alias("n"))
    whole = parts.groupBy("recipe").agg(F.max("keep_id").alias("keep_id"), F.max_by("keep_row", id_("keep_id")).alias("keep_row"), F.sum("n").alias("group_size"))
    back = parts.select("recipe", "salt").join(whole, "recipe")
    return rows.join(back, ["recipe", "salt"]).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, one of each group; told apart by id and text."""
    id_, kept_, n_, sha_ = unused(docs, "id", "kept", "n", "sha")
    last = exact_duplicates(docs).filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    kept = materialize(last.groupBy(F.col("doc_id").alias(id_), F.unhex("text_sha256").alias(kept_)).agg(F.count("*").alias(n_)), "kept")
    sha = F.unhex(F.sha2(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), 256))
    keyed = docs.withColumn(sha_, sha)
    of = lambda which: keyed.join(kept.filter(which), F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(sha_) == F.col(kept_)), "left_semi")
    if kept.filter(F.col(n_) > 1).isEmpty():
        return of(F.col(n_) == 1).drop(sha_)
    # rows that repeat id and text: one of each
    again = of(F.col(n_) > 1).withColumn(id_, F.col("doc_id").cast("long")).dropDuplicates([id_, sha_]).drop(id_)
    return of(F.col(n_) == 1).unionByName(again).drop(sha_)
