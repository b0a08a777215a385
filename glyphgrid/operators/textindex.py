"""The word index of a page: normalised words, their places in the page text, and postings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def index_words(words: DataFrame, normalise: Callable[[Column], Column] | None = None, by_page: bool = False) -> DataFrame:
    """``words`` with ``norm`` and its character interval [char_start, char_end) in the page text.

    The page text is the non-empty normalised words joined by single spaces;
    words that normalise to nothing have no interval. ``by_page``: the words lie by page already.
    """
    norm = normalise(F.col("text")) if normalise else F.col("text")
    # exchanged by page before there is a norm, so that a word goes once
    slim = words.select("page_key", "word_index", "text", "block_index")
    named = (slim if by_page else slim.repartition("page_key")).withColumn("norm", norm)
    before = Window.partitionBy("page_key").orderBy("word_index").rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("norm") != "", F.length("norm") + 1).otherwise(0)
    start = F.coalesce(F.sum(step).over(before), F.lit(0)).cast("int")
    placed = F.col("norm") != ""
    return named.withColumn("char_start", F.when(placed, start)).withColumn("char_end", F.when(placed, start + F.length("norm")).cast("int"))


def placed_words(index: DataFrame) -> DataFrame:
    """``index`` with ``at``, the tokens before a word; the sum runs over the exchange by page that the index has."""
    before = Window.partitionBy("page_key").orderBy("word_index").rowsBetween(Window.unboundedPreceding, -1)
    tokens = F.when(F.col("norm") != "", F.size(F.split("norm", " "))).otherwise(0)
    return index.withColumn("at", F.coalesce(F.sum(tokens).over(before), F.lit(0)).cast("int"))


def page_arrays(index: DataFrame) -> DataFrame:
    """(page_key, words, n): one row a page, its words in order as :func:`placed_words` gives them; ``text``: null where it is the norm, ``at``: where it is the index.

    The rows are gathered on the exchange by page that the index has.
    """
    placed = placed_words(index)
    raw = F.when(F.col("text").eqNullSafe(F.col("norm")), F.lit(None)).otherwise(F.col("text"))
    at = F.when(F.col("at") != F.col("word_index"), F.col("at"))
    fields = F.struct("word_index", raw.alias("text"), "norm", "block_index", "char_start", at.alias("at"))
    return placed.groupBy("page_key").agg(F.array_sort(F.collect_list(fields)).alias("words"), F.count("*").cast("int").alias("n"))


def token_postings(index: DataFrame) -> DataFrame:
    """(page_key, token, word_index): which words hold a token."""
    return index.filter("norm <> ''").select("page_key", "word_index", F.explode(F.array_distinct(F.split("norm", " "))).alias("token"))


def trigram_postings(index: DataFrame) -> DataFrame:
    """(page_key, trigram, word_index): which words hold a trigram in one of their tokens."""
    at = F.explode(F.when(F.length("norm") >= 3, F.sequence(F.lit(1), F.length("norm") - 2))).alias("at")
    cut = index.select("page_key", "word_index", "norm", at).withColumn("trigram", F.substring("norm", F.col("at"), F.lit(3)))
    # of equal ones of a word the first stays
    return cut.filter(~F.contains("trigram", F.lit(" ")) & (F.instr("norm", F.col("trigram")) == F.col("at"))).select("page_key", "word_index", "trigram")


def interval(words: Column, start: Column, end: Column) -> Column:
    """The words from start to end, both included."""
    return F.slice(words, start + 1, end - start + 1)


def end_of(word: Column) -> Column:
    """Where a word of a page's array ends in the page text."""
    return word["char_start"] + F.length(word["norm"])


def raw_text(part: Column) -> Column:
    return F.array_join(F.transform(part, lambda w: F.coalesce(w["text"], w["norm"])), " ")


def norm_text(part: Column) -> Column:
    return F.array_join(F.filter(F.transform(part, lambda w: w["norm"]), lambda t: t != ""), " ")


def in_one_block(part: Column) -> Column:
    """Words without a block are a block of their own."""
    return F.size(F.array_distinct(F.transform(part, lambda w: w["block_index"]))) <= 1
