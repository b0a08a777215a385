"""Secret scans with multipart credential linking; DataFrame functions only.

Three kinds of span are reported wherever they stand: assignments to a secret's
name, access identifiers and long hexadecimal strings. Weaker parts (other
identifiers, short or unusual secrets, endpoints) mean something together only:
an interval join within a scope of ``SCOPE`` characters of one document keeps a
weak identifier if a secret is near, a weak secret if an identifier is near,
and an endpoint if both are.

Spans are in code points, the end exclusive. Defined results: a null text
counts as empty and has no spans, so the digest is that of the empty string;
rows that repeat an id are scanned each for itself; only id and text are read.
Texts are scanned whole, and of a text only its spans are moved.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphgrid.llm.columns import let, running_totals
from glyphgrid.session import materialize

#: Patterns of the base kinds, in the order they are listed, with the least length of what counts.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGNED, WEAKLY_ASSIGNED = 12, 6
#: Patterns of the weak parts.
WEAK_ID = r"""(?i:access_?key(?:_?id)?|client_?id|account_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{4,}"""
WEAK_SECRET = r"""(?i:pwd|pass|passphrase|auth|credentials?|signature|private_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}"""
ENDPOINT = r"""(?i:https?|ftps?|s3|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x00-\x20"'<>]+"""
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}
#: Largest distance, in characters, between the starts of parts that belong together.
SCOPE = 256
#: Characters that are never text: the marks put around matches, and what stands for them where a text holds them.
OPEN, CLOSE, NEITHER = "﷐", "﷑", "﷒"
SPAN = "struct<start:long,kind:int,end:long>"


def unmarked(text: Column) -> Column:
    held = F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE))
    return F.when(held, F.translate(text, OPEN + CLOSE, NEITHER * 2)).otherwise(text)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, size of the first group)."""
    grouped = "$1" if pattern == ASSIGN else ""
    marked = F.regexp_replace(text, F.lit(f"({pattern})"), F.lit(f"{OPEN}$1{CLOSE}" + ("$2" if grouped else "") + (CLOSE if grouped else "")))
    extra = 2 if grouped else 1
    none = F.array().cast("array<struct<start:long,end:long,size:long>>")

    def found(pieces: Column) -> Column:
        # piece 0 stands before the first match; each other one is the match, its mark, its group and mark, and what follows
        match = lambda p: F.length(F.substring_index(p, CLOSE, 1))
        group = (lambda p: F.length(F.substring_index(F.substring_index(p, CLOSE, 2), CLOSE, -1))) if grouped else (lambda p: F.lit(0))
        own = lambda p, i: F.when(i == 0, F.length(p)).otherwise(F.length(p) - extra - group(p)).cast("long")
        before = running_totals(F.transform(pieces, own))
        spans = F.zip_with(pieces, before, lambda p, at: F.struct(at.alias("start"), (at + match(p)).alias("end"), group(p).cast("long").alias("size")))
        return F.slice(spans, F.lit(2), F.size(pieces) - 1)

    return F.when(F.contains(marked, F.lit(OPEN)), let(F.split(marked, OPEN), found)).otherwise(none)


def of_kind(spans: Column, kind: str) -> Column:
    number = F.lit(KINDS.index(kind))
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), number.alias("kind"), s["end"].alias("end")))


def scan(docs: DataFrame) -> DataFrame:
    """Of each row its base spans and its weak parts, by start and kind."""
    text = unmarked(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    found = rows.select("doc_id", *(matches(F.col("text"), p).alias(n) for n, p in (("a", ASSIGN), ("k", ACCESS), ("x", HEX), ("i", WEAK_ID), ("s", WEAK_SECRET), ("e", ENDPOINT))))
    base = F.concat(of_kind(F.filter("a", lambda m: m["size"] >= ASSIGNED), "assign"), of_kind(F.col("k"), "access"), of_kind(F.col("x"), "hex"))
    short = F.filter("a", lambda m: (m["size"] >= WEAKLY_ASSIGNED) & (m["size"] < ASSIGNED))
    weak = F.concat(of_kind(F.col("i"), "weak_id"), of_kind(F.concat(F.col("s"), short), "weak_secret"), of_kind(F.col("e"), "endpoint"))
    return found.select("doc_id", F.monotonically_increasing_id().alias("row"), F.array_sort(base).alias("base"), F.array_sort(F.array_distinct(weak)).alias("weak"))


def linked(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts that have what completes them within the scope of their row.

    The join is on row and bin of ``scope`` characters, so a document of any
    length is spread over many keys; a semi join, so no pairs are formed.
    """
    role = F.element_at(F.array(*(F.lit(ROLES[k]) for k in KINDS)), F.col("span.kind") + 1)
    parts = scanned.filter(F.size("weak") > 0).select("row", F.explode(F.concat("base", "weak")).alias("span")).withColumn("role", role).withColumn("bin", F.floor(F.col("span.start") / scope))
    near = parts.filter("role <> 'endpoint'").select(F.col("row").alias("of"), F.col("role").alias("is"), F.col("span.start").alias("at"), F.explode(F.array(*(F.col("bin") + d for d in (-1, 0, 1)))).alias("there"))

    def beside(df: DataFrame, wanted: str) -> DataFrame:
        n = near.filter(F.col("is") == wanted)
        return df.join(n, (df["row"] == n["of"]) & (df["bin"] == n["there"]) & (F.abs(df["span.start"] - n["at"]) <= scope), "left_semi")

    weak = parts.filter(F.col("span.kind") >= KINDS.index("weak_id"))
    kept = [
        beside(weak.filter("role = 'id'"), "secret"),
        beside(weak.filter("role = 'secret'"), "id"),
        beside(beside(weak.filter("role = 'endpoint'"), "secret"), "id"),
    ]
    return reduce(DataFrame.unionByName, kept).groupBy("row").agg(F.collect_list("span").alias("linked"))


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Counts of the base kinds, the digest of their spans and all spans, for every row."""
    scanned = materialize(scan(docs), "secrets")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    every = F.when(F.col("linked").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", F.col("linked"))))
    return scanned.join(linked(scanned, scope), "row", "left").select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"))
