"""Candidate spans for text values: exact, anchored-fuzzy and combined."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphgrid.functions.text import fixed_point, length_without_blanks, trigrams
from glyphgrid.operators.labels import require
from glyphgrid.operators.textindex import end_of, in_one_block, interval, norm_text, page_arrays, placed_words, raw_text
from glyphgrid.schemas import SCALE
from glyphgrid.session import materialize_by_page, page_parts

EPSILON = 1e-12
#: Hashes of what a page's queries are made of, up to which its words are compared with them all.
WANTED = 512
COLUMNS = (
    "page_key", "candidate_id", "region_id", "start_word", "end_word", "start_char", "end_char", "query_text", "matched_text",
    "normalized_query_text", "normalized_matched_text", "exact", "edit_distance", "cer_int", "similarity_int", "query_length", "quality_chars", "source",
)


@dataclass(frozen=True)
class Fuzzy:
    """Options of the anchored-fuzzy generator (fixed defaults)."""

    length_boundary: int = 6
    max_cer: float = 0.20
    max_edits: int = 1
    max_candidates: int = 5
    max_starts: int = 12
    word_delta: int = 2
    start_shift: int = 1
    max_postings: int = 64
    max_features: int = 12
    cross_block: bool = True

    def __post_init__(self):
        require(self.length_boundary > 0 and self.max_candidates > 0 and self.max_starts > 0 and self.max_postings > 0 and self.max_features > 0, "limits must be positive")
        require(0 <= self.max_cer <= 1, "the error rate must be in [0, 1]")
        require(self.max_edits >= 0 and self.word_delta >= 0 and self.start_shift >= 0, "edits and deltas must not be negative")

    @property
    def has_cliff(self) -> bool:
        """Is less allowed at the boundary than below it."""
        return self.max_cer * self.length_boundary + EPSILON < self.max_edits


def accepted(distance: Column, length: Column, solid: Column, boundary: int, max_cer: float, max_edits: int) -> Column:
    """Long values by error rate over their whole length, short ones by edits; ``solid``: length without blanks."""
    return F.when(solid >= boundary, distance / length <= max_cer + EPSILON).otherwise(distance <= max_edits)


def in_order(candidates: DataFrame) -> DataFrame:
    """Candidates numbered in each page by region, span, exactness, distance and source."""
    order = Window.partitionBy("page_key").orderBy("region_id", "start_word", "end_word", F.desc("exact"), "edit_distance", "source")
    return candidates.withColumn("candidate_id", (F.row_number().over(order) - 1).cast("int")).select(*COLUMNS)


def queries_of(values: DataFrame) -> DataFrame:
    """The different normalised values of each page with their tokens, by page; each is looked for once."""
    asked = values.filter("norm <> ''").select("page_key", F.col("norm").alias("query"))
    return asked.repartition(page_parts(values.sparkSession), "page_key").distinct().withColumn("tokens", F.split("query", " "))


def for_values(values: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans found for a query, given to every value with that query, as candidates."""
    own = values.select("page_key", "region_id", F.col("input_text").alias("query_text"), F.col("norm").alias("query"))
    rate = F.col("edit_distance") / F.length("query")
    return in_order(
        own.join(spans, ["page_key", "query"])
        .withColumn("exact", F.col("edit_distance") == 0)
        .withColumn("cer_int", fixed_point(rate, SCALE))
        .withColumn("similarity_int", fixed_point(F.greatest(F.lit(0.0), 1 - rate), SCALE))
        .withColumn("query_length", length_without_blanks(F.col("query")).cast("int"))
        .withColumn("quality_chars", F.greatest(F.lit(0), F.length("query") - F.col("edit_distance")).cast("int"))
        .withColumn("edit_distance", F.col("edit_distance").cast("int"))
        .withColumnRenamed("query", "normalized_query_text")
    )


def features(token: Column) -> Column:
    """A token (kind 0) and its different trigrams (kind 1)."""
    kind = lambda k, g: F.struct(F.lit(k).alias("kind"), g.alias("gram"))
    return F.concat(F.array(kind(0, token)), F.transform(trigrams(token), lambda g: kind(1, g)))


def asked_features(queries: DataFrame) -> DataFrame:
    """(page_key, query, qi, kind, gram) of the tokens of queries."""
    return queries.select("page_key", "query", F.posexplode("tokens").alias("qi", "token")).select("page_key", "query", "qi", F.explode(features(F.col("token"))).alias("f")).select("page_key", "query", "qi", "f.*")


def wanted_hashes(values: DataFrame) -> DataFrame:
    """(page_key, wanted): hashes of what the queries of each page are made of; null where there are more than ``WANTED``."""
    hashes = asked_features(queries_of(values)).groupBy("page_key").agg(F.collect_set(F.xxhash64("kind", "gram")).alias("wanted"))
    return hashes.withColumn("wanted", F.when(F.size("wanted") <= WANTED, F.col("wanted")))


def prepared(values: DataFrame, index: DataFrame) -> DataFrame:
    """(page_key, words, n, wanted): the pages that have queries, and hashes of what these are made of, written once.

    What several searches need of a page then lies in its row, and what has none of the
    hashes is left out where it lies. ``wanted`` is null, and nothing left out, where there are more than ``WANTED``.
    They are written in buckets of pages: searches, and what they find, meet them without an exchange.
    ``index`` may be one row a page already (``words``, ``n``), as :func:`page_arrays` makes it.
    """
    pages = index if "words" in index.columns else page_arrays(index)
    return materialize_by_page(pages.join(wanted_hashes(values), "page_key"), "pages")


def words_of(pages: DataFrame) -> DataFrame:
    each = pages.select("page_key", "wanted", F.inline("words"))
    return each.withColumn("text", F.coalesce("text", "norm")).withColumn("at", F.coalesce("at", "word_index")).withColumn("char_end", F.col("char_start") + F.length("norm"))


def is_wanted(kind: Column, gram: Column) -> Column:
    return F.coalesce(F.array_contains("wanted", F.xxhash64(kind, gram)), F.lit(True))


def token_stream(words: DataFrame) -> DataFrame:
    """(page_key, at, token, word, first, last): tokens of words and their place in the page; is it the first or last of its word."""
    each = words.filter("norm <> ''").withColumn("k", F.size(F.split("norm", " "))).select("page_key", F.col("word_index").alias("word"), "k", "at", F.posexplode(F.split("norm", " ")).alias("i", "token"))
    return each.select("page_key", (F.col("at") + F.col("i")).alias("at"), "token", "word", (F.col("i") == 0).alias("first"), (F.col("i") == F.col("k") - 1).alias("last"))


def runs_of_tokens(stream: DataFrame, sizes: list[int]) -> DataFrame:
    """(page_key, at, size, hash): the hash of the tokens from each one on, if none is left out, for sizes that are powers of two; by doubling."""
    order = Window.partitionBy("page_key").orderBy("at")
    widest, size, hashed = max(sizes), 1, stream.withColumn("h1", F.xxhash64("token"))
    while size < widest:
        hashed = hashed.withColumn(f"h{2 * size}", F.when((F.lead("at", size).over(order) == F.col("at") + size) & F.lead(f"h{size}", size).over(order).isNotNull(), F.xxhash64(f"h{size}", F.lead(f"h{size}", size).over(order))))
        size *= 2
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("size"), F.col(f"h{n}").alias("hash")) for n in sizes)))
    return hashed.filter("first").select("page_key", "at", each.alias("r")).filter("r.hash IS NOT NULL").select("page_key", "at", "r.size", "r.hash")


def exact_spans(values: DataFrame, index: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Every place where the words of a page spell a query, overlapping ones too; a place begins and ends with a word.

    Of a page only words with a token of one of its queries are looked at, and
    those without any. The first tokens of a query, as many as the largest power of two in it, are
    one hash, an equi-join with the hashes of as many tokens from every place of
    the page. Only the tokens of what this finds are compared.
    """
    queries = queries_of(values).withColumn("size", F.pow(F.lit(2), F.floor(F.log2(F.size("tokens")))).cast("int"))
    heads = F.transform("tokens", lambda t: F.xxhash64(t))
    sizes = sorted(r["size"] for r in queries.select("size").distinct().collect())  # a few powers of two
    if not sizes:
        sizes = [1]
    halves, size = heads, 1
    of_size = F.when(F.col("size") == 1, F.get(heads, F.lit(0)))
    while size < sizes[-1]:
        halves, size = pairs_hashed(halves), 2 * size
        of_size = of_size.when(F.col("size") == size, F.get(halves, F.lit(0)))
    some = F.exists(F.split("norm", " "), lambda token: is_wanted(F.lit(0), token))
    simple = F.when(F.instr("norm", " ") == 0, is_wanted(F.lit(0), F.col("norm"))).otherwise(some)
    # without prepared pages the words are filtered where they lie, and pages never gathered
    if pages is None and "words" in index.columns:
        pages = index.join(wanted_hashes(values), "page_key")
    whole = words_of(pages) if pages is not None else placed_words(index).join(wanted_hashes(values), "page_key")
    words = materialize_by_page(whole.filter((F.col("norm") == "") | simple).drop("wanted"), "words-wanted")
    stream = token_stream(words)
    starts = queries.withColumn("hash", of_size).join(runs_of_tokens(stream, sizes), ["page_key", "size", "hash"]).select("page_key", "query", "at", F.posexplode("tokens").alias("j", "wanted"))
    met = starts.withColumn("place", F.col("at") + F.col("j")).join(stream.withColumnRenamed("at", "place"), ["page_key", "place"])
    spelled = met.groupBy("page_key", "query", "at").agg(
        F.count_if(F.col("token") == F.col("wanted")).alias("same"), F.min("word").alias("start_word"), F.max("word").alias("end_word"), F.max_by("last", "j").alias("ends"), F.min_by("first", "j").alias("begins"),
    )
    found = spelled.filter((F.col("same") == F.size(F.split("query", " "))) & F.col("begins") & F.col("ends")).select("page_key", "query", "start_word", "end_word")
    inside = found.withColumn("word_index", F.explode(F.sequence("start_word", "end_word"))).join(words.select("page_key", "word_index", "text", "norm", "char_start", "char_end"), ["page_key", "word_index"])
    spans = inside.groupBy("page_key", "query", "start_word", "end_word").agg(F.array_sort(F.collect_list(F.struct("word_index", "text", "norm", "char_start", "char_end"))).alias("span"))
    return spans.select(
        "page_key", "query", "start_word", "end_word", F.element_at("span", 1)["char_start"].alias("start_char"), F.element_at("span", -1)["char_end"].alias("end_char"),
        raw_text(F.col("span")).alias("matched_text"), F.col("query").alias("normalized_matched_text"), F.lit(0).alias("edit_distance"), F.lit("exact").alias("source"),
    )


def pairs_hashed(hashes: Column) -> Column:
    """Of hashes of runs of n tokens that follow each other, those of 2n: neighbours joined two by two."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(hashes) / 2) - 1, F.lit(0))), lambda i: F.xxhash64(F.get(hashes, (2 * i).cast("int")), F.get(hashes, (2 * i + 1).cast("int"))))


def exact_candidates(values: DataFrame, index: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Exact candidates; ``values``: page_key, region_id, input_text, norm; ``pages``: what :func:`prepared` gave, if it is at hand."""
    return for_values(values, exact_spans(values, index, pages))


def start_votes(queries: DataFrame, pages: DataFrame, options: Fuzzy = Fuzzy()) -> DataFrame:
    """(page_key, query, start, votes): where shared tokens and rare shared trigrams say that a query begins.

    ``pages`` are :func:`prepared`: tokens (kind 0) and trigrams (kind 1) that no
    query of the page has go no further than their row.
    """
    asked = asked_features(queries)
    tokens = words_of(pages).filter("norm <> ''").select("page_key", "wanted", "word_index", F.explode(F.split("norm", " ")).alias("token"))
    cut = tokens.withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.length("token") - 2, F.lit(0)))))
    kind, gram = F.when(F.col("i") > 0, 1).otherwise(0), F.when(F.col("i") == 0, F.col("token")).otherwise(F.substring("token", F.col("i"), F.lit(3)))
    held = cut.select("page_key", "wanted", "word_index", kind.alias("kind"), gram.alias("gram")).filter(is_wanted(F.col("kind"), F.col("gram"))).drop("wanted")
    key = ["page_key", "kind", "gram"]
    places = held.join(asked.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.collect_set("word_index").alias("places"))
    postings = places.withColumn("postings", F.size("places").cast("long")).filter(F.col("postings") <= options.max_postings)
    budget = Window.partitionBy("page_key", "query", "kind").orderBy("postings", "qi", "gram")
    hits = asked.join(postings, key).withColumn("rank", F.row_number().over(budget)).filter((F.col("kind") == 0) | (F.col("rank") <= options.max_features))
    weight = F.when(F.col("kind") == 0, 3 + F.floor(F.floor(F.lit(options.max_postings) / F.col("postings")) / 8)).otherwise(F.lit(1).cast("long"))
    voted = hits.select("page_key", "query", "qi", weight.alias("weight"), F.explode("places").alias("place"))
    return voted.groupBy("page_key", "query", (F.col("place") - F.col("qi")).alias("start")).agg(F.sum("weight").alias("votes"))


def top_starts(votes: DataFrame, options: Fuzzy = Fuzzy()) -> DataFrame:
    best = Window.partitionBy("page_key", "query").orderBy(F.desc("votes"), "start")
    return votes.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= options.max_starts).select("page_key", "query", "start")


def windows_around(starts: DataFrame, queries: DataFrame, sizes: DataFrame, options: Fuzzy = Fuzzy(), shift: int | None = None) -> DataFrame:
    """(page_key, query, start_word, end_word): the different windows near the starts, inside the page."""
    by = options.start_shift if shift is None else shift
    near = starts.join(queries.select("page_key", "query", F.size("tokens").alias("k")), ["page_key", "query"]).join(sizes, "page_key")
    moved = near.select("page_key", "query", "k", "n", F.explode(F.sequence((F.col("start") - by).cast("int"), (F.col("start") + by).cast("int"))).alias("start_word")).distinct()
    sized = moved.select("page_key", "query", "start_word", "n", F.explode(F.sequence(F.greatest(F.lit(1), F.col("k") - options.word_delta), F.col("k") + options.word_delta)).alias("count"))
    ended = sized.withColumn("end_word", F.col("start_word") + F.col("count") - 1)
    return ended.filter("start_word >= 0 AND end_word < n").select("page_key", "query", "start_word", "end_word")


def most_edits(query: Column, options: Fuzzy) -> Column:
    """No accepted text is farther from a query."""
    return F.when(length_without_blanks(query) >= options.length_boundary, F.floor(F.length(query) * options.max_cer + EPSILON).cast("int")).otherwise(F.lit(options.max_edits))


def pieces(query: Column, most: Column) -> Column:
    """A query in one piece more than it may have edits: what is as near to it holds one of them unchanged."""
    cut = lambda j: F.floor(j * F.length(query) / (most + 1)).cast("int")
    return F.transform(F.sequence(F.lit(0), most), lambda j: F.substring(query, cut(j) + 1, cut(j + 1) - cut(j)))


def within_reach(page: Column, asked: Column) -> Column:
    """Those of the queries ``asked`` (with their ``pieces``) of which the page's text has a piece; no window is near to the others."""
    held = lambda text: F.filter(asked, lambda q: F.exists(q["pieces"], lambda p: F.contains(text, p)))
    return F.when(asked.isNotNull(), F.get(F.transform(F.array(norm_text(page)), held), F.lit(0)))  # the text is put together once


def fits(q: Column, words: Column, start: Column, end: Column) -> Column:
    """Is a window as long as what may be near to a query (query, most); what begins or ends with a word that is nothing is not."""
    return F.abs(F.length(q["query"]) - end_of(F.get(words, end)) + F.get(words, start)["char_start"]) <= q["most"]


def of_start(words: Column, q: Column, at: Column, options: Fuzzy) -> Column:
    """The windows of a page's words that begin at a word and are of a possible length for a query (query, k, most)."""
    ends = F.transform(F.sequence(F.greatest(F.lit(1), q["k"] - options.word_delta), q["k"] + options.word_delta), lambda c: (at + c - 1).cast("int"))
    return F.transform(F.filter(ends, lambda e: fits(q, words, at, e)), lambda e: F.struct(at.cast("int").alias("start_word"), e.alias("end_word")))


def everywhere(words: Column, q: Column, options: Fuzzy) -> Column:
    """All windows of a page's words that are of a possible length for a query."""
    return F.flatten(F.transform(words, lambda w, at: of_start(words, q, at, options)))


def around(words: Column, q: Column, options: Fuzzy) -> Column:
    """The different windows near the ``starts`` of a query, as :func:`windows_around` has them, of a possible length."""
    near = F.array_distinct(F.flatten(F.transform(q["starts"], lambda s: F.sequence((s - options.start_shift).cast("int"), (s + options.start_shift).cast("int")))))
    inside = F.filter(near, lambda at: (at >= 0) & (at < F.size(words)))
    return F.flatten(F.transform(inside, lambda at: of_start(words, q, at, options)))


def scored_windows(starts: DataFrame, queries: DataFrame, unvoted: DataFrame, pages: DataFrame, options: Fuzzy = Fuzzy()) -> DataFrame:
    """Windows whose text is near enough to their query, from one block if any is, else (if allowed) across blocks.

    Those near ``starts`` are looked at, and for the queries ``unvoted`` all of the page.
    """
    # a page's words meet what is asked of them once; windows too long, too short or too far are never cut out
    words, most, k = F.col("words"), most_edits(F.col("query"), options).alias("most"), F.size("tokens").alias("k")
    voted = starts.groupBy("page_key", "query").agg(F.collect_list("start").alias("starts")).join(queries.select("page_key", "query", k), ["page_key", "query"])
    listed = voted.groupBy("page_key").agg(F.collect_list(F.struct("query", "k", most, "starts")).alias("asked"))
    few = unvoted.select("page_key", "query", k, most)
    blank = few.groupBy("page_key").agg(F.collect_list(F.struct("query", "k", "most", pieces(F.col("query"), F.col("most")).alias("pieces"))).alias("open"))
    both = pages.join(listed, "page_key", "left").join(blank, "page_key", "left").filter("asked IS NOT NULL OR open IS NOT NULL")
    part = lambda s: interval(words, s["start_word"], s["end_word"])
    # beyond the most edits allowed the distance is not worked out
    near = lambda q, some: F.filter(some, lambda s: F.call_function("levenshtein", q["query"], norm_text(part(s)), q["most"]) >= 0)
    cut_out = lambda q, some, source: F.transform(near(q, some), lambda s: F.struct(q["query"].alias("query"), s["start_word"].alias("start_word"), s["end_word"].alias("end_word"), F.lit(source).alias("source"), part(s).alias("part")))
    voted = F.transform("asked", lambda q: cut_out(q, around(words, q, options), "fuzzy-anchor"))
    other = F.transform(within_reach(words, F.col("open")), lambda q: cut_out(q, everywhere(words, q, options), "fuzzy-length-fallback"))
    every = F.explode(F.flatten(F.filter(F.array(F.flatten(voted), F.flatten(other)), lambda some: some.isNotNull())))
    cut = both.select("page_key", every.alias("c")).select("page_key", "c.*")
    solid = length_without_blanks(F.col("query"))
    most = most_edits(F.col("query"), options)
    first, last = F.element_at("part", 1), F.element_at("part", -1)
    texts = cut.filter((first["norm"] != "") & (last["norm"] != "")).select(
        "page_key", "query", "start_word", "end_word", "source", first["char_start"].alias("start_char"), end_of(last).alias("end_char"),
        raw_text(F.col("part")).alias("matched_text"), norm_text(F.col("part")).alias("normalized_matched_text"), in_one_block(F.col("part")).alias("one_block"), most.alias("most"), solid.alias("solid"),
    )
    # the difference in length bounds the distance from below
    possible = texts.filter(F.abs(F.length("query") - F.length("normalized_matched_text")) <= F.col("most"))
    measured = possible.withColumn("edit_distance", F.levenshtein("query", "normalized_matched_text"))
    good = measured.filter((F.col("edit_distance") > 0) & accepted(F.col("edit_distance"), F.length("query"), F.col("solid"), options.length_boundary, options.max_cer, options.max_edits))
    if not options.cross_block:
        return good.filter("one_block").drop("most", "solid", "one_block")
    any_ = F.max(F.col("one_block").cast("int")).over(Window.partitionBy("page_key", "query")) == 1
    named = F.when(F.col("one_block"), F.col("source")).otherwise(F.concat("source", F.lit("-cross-block")))
    return good.withColumn("keep", F.col("one_block") == any_).filter("keep").withColumn("source", named).drop("most", "solid", "one_block", "keep")


def retained(scored: DataFrame, limit: int = 5) -> DataFrame:
    """At most ``limit`` spans a query: the best that do not overlap, then the best of the rest."""
    fields = ("start_word", "end_word", "edit_distance", "start_char", "end_char", "matched_text", "normalized_matched_text", "source")
    ranked = F.struct((F.length("query") - F.col("edit_distance")).alias("worth"), *fields)
    key = lambda s: F.struct(F.greatest(F.lit(0), s["worth"]) * -1, s["edit_distance"], s["start_word"], s["end_word"])
    less = lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)
    lists = scored.groupBy("page_key", "query").agg(F.array_sort(F.collect_list(ranked), less).alias("s"))
    apart = lambda kept, s: F.forall(kept, lambda k: (s["end_word"] < k["start_word"]) | (k["end_word"] < s["start_word"]))
    none = F.slice("s", F.lit(1), F.lit(0))
    lists = lists.withColumn("far", F.aggregate("s", none, lambda kept, s: F.when((F.size(kept) < limit) & apart(kept, s), F.array_append(kept, s)).otherwise(kept)))
    rest = F.array_except("s", "far")
    return lists.select("page_key", "query", F.explode(F.slice(F.concat("far", rest), 1, limit)).alias("s")).select("page_key", "query", *(f"s.{f}" for f in fields))


def fuzzy_spans(values: DataFrame, index: DataFrame, options: Fuzzy = Fuzzy(), pages: DataFrame | None = None) -> DataFrame:
    """Spans near to the queries; where a query has no vote at all, windows everywhere in its page."""
    pages = prepared(values, index) if pages is None else pages
    # each is read several times below: computed once and written
    queries = materialize_by_page(queries_of(values), "queries")
    votes = materialize_by_page(start_votes(queries, pages, options), "start-votes")
    unvoted = queries.join(votes.select("page_key", "query").distinct(), ["page_key", "query"], "left_anti")
    return retained(scored_windows(top_starts(votes, options), queries, unvoted, pages.select("page_key", "words"), options), options.max_candidates)


def fuzzy_candidates(values: DataFrame, index: DataFrame, options: Fuzzy = Fuzzy(), pages: DataFrame | None = None) -> DataFrame:
    return for_values(values, fuzzy_spans(values, index, options, pages))


def exact_and_fuzzy(values: DataFrame, index: DataFrame, options: Fuzzy = Fuzzy()) -> DataFrame:
    """Exact candidates first, then fuzzy ones; the pages are prepared once."""
    pages = prepared(values, index)
    return combined([exact_candidates(values, index, pages), fuzzy_candidates(values, index, options, pages)])


def combined(generated: Sequence[DataFrame]) -> DataFrame:
    """Candidates of several generators; of equal spans of a region the earlier generator's stays."""
    require(len(generated) > 0, "at least one generator is needed")
    numbered = reduce(DataFrame.unionByName, (g.withColumn("generator", F.lit(k)) for k, g in enumerate(generated)))
    first = Window.partitionBy("page_key", "region_id", "start_word", "end_word").orderBy("generator", "candidate_id")
    return in_order(numbered.withColumn("rank", F.row_number().over(first)).filter("rank = 1").drop("rank", "generator", "candidate_id"))
