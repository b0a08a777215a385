"""Quality rules by distribution divergence; DataFrame functions only.

A document's histograms of character classes and of its language's most common
words are compared with those of the whole language by the Jensen-Shannon
distance (square root of the divergence to base 2, so 0 to 1). The references
are counted over all documents. Documents too short for a histogram to mean
anything pass this rule.

Defined results: a null text has no words and fails the base rule; a null
language is a language of its own; a language whose documents have no words has
no common words and only the character classes count. Rows are judged one by
one, so repeated rows get equal results; an empty table gives an empty result.
Columns other than id, text and language are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphgrid.llm.columns import BLANKS, each_index, let, total, words
from glyphgrid.session import materialize

#: Characters counted as symbols (fixed by the rule).
SYMBOLS = "[#*$%&|<>]"
#: Classes in the order of the histogram.
CLASSES = ("upper", "letter", "digit", "blank", "symbol", "point", "other")
#: Words in a language's histogram; all other words together are one more class.
COMMON = 24
#: Below so many words the divergence is not judged.
SHORTEST = 50
#: Largest distances that pass.
MOST_CHARS, MOST_WORDS = 0.35, 0.75
WINDOW = 5


def removed(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def repeated_words(ws: Column, n: int = WINDOW) -> Column:
    """Words that lie in an n-word window found twice or more in the text."""

    def covered(windows: Column) -> Column:
        ranked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        again = let(ranked, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, k: same(s, x, k + 1) | same(s, x, k - 1)), lambda x: x["i"])))
        return let(again, lambda p: total(F.transform(p, lambda at, k: F.least(F.lit(n), F.coalesce(F.get(p, k + 1) - at, F.lit(n))).cast("long"))))

    def counted(hs: Column) -> Column:
        windows = F.transform(each_index(F.size(hs) - (n - 1)), lambda i: F.xxhash64(*(F.get(hs, i + k) for k in range(n))))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)))

    return let(F.transform(ws, lambda w: F.xxhash64(w)), counted)


def common_words(docs: DataFrame, k: int = COMMON) -> dict[str | None, list[tuple[str, float]]]:
    """The k most common words of each language with their share of its words, most common first."""
    counts = docs.select("lang", F.explode(words(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    counts = materialize(counts, "word-counts")
    sums = counts.groupBy("lang").agg(F.sum("n").alias("all"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = counts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    known = {r["lang"]: r["all"] for r in sums.collect()}
    found: dict[str | None, list[tuple[str, float]]] = {}
    for r in sorted(top.collect(), key=lambda r: r["rank"]):
        found.setdefault(r["lang"], []).append((r["word"], r["n"] / known[r["lang"]]))
    return found


def shares(counts: Column) -> Column:
    return let(counts, lambda c: let(F.greatest(total(c), F.lit(1)), lambda n: F.transform(c, lambda x: x / n)))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares of equal length."""

    def part(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    both = F.zip_with(p, q, lambda a, b: let((a + b) / 2, lambda m: part(a, m) + part(b, m)))
    return F.sqrt(F.greatest(F.aggregate(both, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def features(docs: DataFrame, common: dict[str | None, list[tuple[str, float]]]) -> DataFrame:
    """One row a document: the base counts, the class counts and the common words' counts."""
    rest = docs.withColumn("words", words(F.col("text"))).withColumn("marks", removed(F.col("text"), r"\p{L}+"))
    length, left = F.length("text"), F.length("marks")
    gone = lambda pattern: left - F.length(removed(F.col("marks"), pattern))
    upper = F.length(removed(F.col("text"), r"\P{Lu}+"))
    symbols, blanks, digits, points = gone(SYMBOLS), gone(BLANKS), gone(r"\p{Nd}+"), gone(r"[.,;:!?'\"()\[\]{}-]+")
    classes = F.array(*(x.cast("long") for x in (upper, length - left - upper, digits, blanks, symbols, points, left - digits - blanks - symbols - points)))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def hits(ws: list[str]) -> Column:
        if not ws:
            return F.array().cast("array<long>")
        return let(F.filter(F.col("words"), lambda w: w.isin(ws)), lambda c: F.transform(F.array(*map(F.lit, ws)), lambda r: F.size(F.filter(c, lambda w: w == r)).cast("long")))

    of_language = F.array().cast("array<long>")
    for lang, ws in common.items():
        of_language = F.when(F.col("lang").eqNullSafe(F.lit(lang)), hits([w for w, _ in ws])).otherwise(of_language)
    return rest.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        (length - blanks).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        classes.alias("classes"),
        of_language.alias("hits"),
    )


def judge(docs: DataFrame, k: int = COMMON, shortest: int = SHORTEST, most_chars: float = MOST_CHARS, most_words: float = MOST_WORDS) -> DataFrame:
    """Every document with its counts, its two distances and the verdict."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    common = common_words(base, k)
    found = materialize(features(base, common), "quality")
    sums = found.groupBy("lang").agg(*(F.sum(F.col("classes")[i]).alias(c) for i, c in enumerate(CLASSES)))
    char_share, word_share = F.lit(None).cast("array<double>"), F.lit(None).cast("array<double>")
    for r in sums.collect():
        n, mine = max(sum(r[c] for c in CLASSES), 1), F.col("lang").eqNullSafe(F.lit(r["lang"]))
        char_share = F.when(mine, F.array(*(F.lit(r[c] / n) for c in CLASSES))).otherwise(char_share)
        ws = [p for _, p in common.get(r["lang"], [])]
        word_share = F.when(mine, F.array(*map(F.lit, [*ws, max(1.0 - sum(ws), 0.0)]))).otherwise(word_share)
    in_words = let(F.col("hits"), lambda h: shares(F.concat(h, F.array(F.col("n_words") - total(h)))))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    odd = (F.col("n_words") >= shortest) & ((F.col("js_chars") > most_chars) | (F.col("js_words") > most_words))
    return (
        found.withColumn("js_chars", distance(shares(F.col("classes")), char_share))
        .withColumn("js_words", distance(in_words, word_share))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~F.coalesce(odd, F.lit(False))).alias("kept"), "js_chars", "js_words")
    )
