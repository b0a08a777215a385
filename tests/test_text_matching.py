"""Candidates, selection, ordered alignment and normalisation against literal cases and brute force."""

import itertools
import random

import pytest

from glyphgrid.functions.text import normalise
from glyphgrid.operators import candidates as C
from glyphgrid.operators import select as S
from glyphgrid.operators.choice import best_of
from glyphgrid.operators.ordered import aligned_characters, ordered_candidates, runs
from glyphgrid.operators.textindex import index_words
from glyphgrid.plans.aligners import TextAlignment


def page(spark, *texts, blocks=None):
    rows = [("p", k, t, 10.0 * k, 0.0, 8.0, 10.0, 0, 0 if blocks is None else blocks[k]) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "page_key string, word_index int, text string, x double, y double, width double, height double, line_index int, block_index int")


def values(spark, *texts):
    return spark.createDataFrame([("p", k, f"v{k}", t, t) for k, t in enumerate(texts)], "page_key string, region_id int, label string, input_text string, norm string")


def fuzzy(spark, query, *texts, blocks=None, **options):
    index = index_words(page(spark, *texts, blocks=blocks))
    return [(r.start_word, r.end_word, r.edit_distance, r.source, r.quality_chars) for r in C.fuzzy_candidates(values(spark, query), index, C.Fuzzy(**options)).orderBy("candidate_id").collect()]


def test_short_value_by_length_fallback(spark):
    assert fuzzy(spark, "rome", "reme") == [(0, 0, 1, "fuzzy-length-fallback", 3)]


def test_anchored_phrase(spark):
    assert (0, 2, 1, "fuzzy-anchor", 14) in fuzzy(spark, "library of reme", "library", "of", "rome")


def test_cross_block_only_without_a_block(spark):
    out = fuzzy(spark, "library of reme", "library", "of", "rome", blocks=[0, 0, 1])
    assert (0, 2, 1, "fuzzy-anchor-cross-block", 14) in out
    assert fuzzy(spark, "library of reme", "library", "of", "rome", blocks=[0, 0, 1], cross_block=False) == []


def test_retention_prefers_other_places(spark):
    assert [x[:2] for x in fuzzy(spark, "rome", "reme", "noise", "reme", max_candidates=2)] == [(0, 0), (2, 2)]


def test_error_rate_boundary(spark):
    assert len(fuzzy(spark, "abcdef", "abcxef", max_cer=0.20)) == 1
    assert fuzzy(spark, "abcdef", "abcxef", max_cer=0.15) == []


def test_exact_overlapping_and_multi_token_words(spark):
    index = index_words(page(spark, "a", "a", "a", "b c", "d"))
    got = {(r.region_id, r.start_word, r.end_word) for r in C.exact_candidates(values(spark, "a a", "b c d", "c d"), index).collect()}
    assert got == {(0, 0, 1), (0, 1, 2), (1, 3, 4)}


def test_combined_keeps_the_first_generator(spark):
    index, v = index_words(page(spark, "rome", "reme")), values(spark, "rome")
    exact = C.exact_candidates(v, index)
    both = C.combined([exact, C.fuzzy_candidates(v, index)])
    assert {(r.start_word, r.source) for r in both.collect()} >= {(0, "exact")}
    assert C.combined([exact, exact]).count() == 1


def brute(spans):
    best = None
    for n in range(len(spans) + 1):
        for pick in itertools.combinations(spans, n):
            words = [w for s in pick for w in range(s[2], s[3] + 1)]
            if len({s[1] for s in pick}) < n or len(set(words)) < len(words):
                continue
            value = (sum(s[4] for s in pick), sum(s[5] for s in pick), n, -sum(s[2] for s in pick), -sum(s[0] + 1 for s in pick), sum((s[0] + 1) ** 2 for s in pick))
            if best is None or value > best:
                best = value
    return best


def worth(spans, ids):
    pick = [s for s in spans if s[0] in ids]
    words = [w for s in pick for w in range(s[2], s[3] + 1)]
    assert len(pick) == len(ids) and len(set(words)) == len(words) and len({s[1] for s in pick}) == len(pick)
    return (sum(s[4] for s in pick), sum(s[5] for s in pick), len(pick), -sum(s[2] for s in pick), -sum(s[0] + 1 for s in pick), sum((s[0] + 1) ** 2 for s in pick))


def random_spans(rng, n, regions, words, quality, exact=2):
    spans = []
    for k in range(n):
        start = rng.randrange(0, words)
        spans.append((k, rng.randrange(0, regions), start, start + rng.randrange(0, 3), quality(rng), rng.randrange(0, exact)))
    return spans


@pytest.mark.parametrize("quality", [lambda rng: rng.randrange(1, 6), lambda rng: 5, lambda rng: rng.randrange(0, 2)])
def test_selection_against_enumeration(quality):
    rng = random.Random(7)
    for _ in range(150):
        spans = random_spans(rng, rng.randrange(1, 10), 4, 8, quality)
        ids, optimal = best_of(spans)
        assert optimal and worth(spans, ids) == brute(spans)


def test_selection_in_parts(spark):
    rng = random.Random(8)
    pages = {f"p{k}": random_spans(rng, 12, 6, 30, lambda r: r.randrange(1, 4)) for k in range(12)}
    # a chain of parts that labels have to walk: region k and k + 1 share a word
    pages["chain"] = [(2 * k + i, k, 2 * k + i, 2 * k + i + 1 + i, 3, 1) for k in range(40) for i in (0, 1)]
    rows = [(p, *s, "clash") for p, spans in pages.items() for s in spans]
    df = spark.createDataFrame(rows, "page_key string, candidate_id int, region_id int, start_word int, end_word int, quality_chars int, exact int, part string")
    found = S.choices(df).collect()
    assert {r.status for r in found} == {S.OPTIMAL}
    for p, spans in pages.items():
        ids = [r.candidate_id for r in found if r.page_key == p]
        assert worth(spans, ids) == (brute(spans) if p != "chain" else worth(spans, best_of(spans)[0]))
    assert len({r.part for r in S.parts(df.filter("page_key = 'chain'")).collect()}) == 1
    assert S.choices(df.limit(0)).count() == 0


def test_crowded_parts_are_settled_in_little_time():
    rng = random.Random(9)
    for regions, words in ((20, 30), (30, 40), (60, 40), (60, 300)):
        spans = []
        for region in range(regions):
            length, quality = rng.randint(1, 3), rng.randint(1, 20)
            for _ in range(5):
                start = rng.randrange(words - length)
                spans.append((len(spans), region, start, start + length - 1, quality, 1))
        ids, optimal = best_of(spans, 30)
        assert optimal
        worth(spans, ids)


def test_values_that_stand_for_each_other():
    spans = [(r * 50 + k, r, 2 * k, 2 * k, 1, 1) for r in range(30) for k in range(50)]
    ids, optimal = best_of(spans)
    assert optimal and worth(spans, ids)[:4] == (30, 30, 30, -2 * sum(range(30)))


def test_a_search_cut_short_is_an_error_or_said(spark):
    rng = random.Random(10)
    spans = [(5 * r + k, r, s := rng.randrange(0, 80), s + rng.randrange(0, 3), 5, 1) for r in range(80) for k in range(5)]
    df = spark.createDataFrame([("p", *s) for s in spans], "page_key string, candidate_id int, region_id int, start_word int, end_word int, quality_chars int, exact int")
    with pytest.raises(Exception, match="shown to be the best"):
        S.choices(df, 1e-9).collect()
    found = S.choices(df, 1e-9, require_optimal=False).collect()
    assert S.FEASIBLE in {r.status for r in found}
    worth(spans, [r.candidate_id for r in found])
    with pytest.raises(ValueError):
        S.choices(df, 0.0)


def test_long_fuzzy_beats_short_exact(spark):
    out = TextAlignment(normalizers=["lowercase"]).align(values(spark, "Rome", "Library of Reme").drop("norm"), page(spark, "Library", "of", "Rome"))
    assert {r.region_id: r.alto_text for r in out.collect()} == {0: None, 1: "Library of Rome"}


def table(a, b):
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return d


def walk(a, b):
    d, out, i, j = table(a, b), [None] * len(a), len(a), len(b)
    while i and j:
        if (a[i - 1] == b[j - 1] and d[i - 1][j - 1] == d[i][j]) or d[i - 1][j - 1] + 1 == d[i][j]:
            i, j = i - 1, j - 1
            out[i] = j
        elif d[i - 1][j] + 1 == d[i][j]:
            i -= 1
        else:
            j -= 1
    return out


def test_banded_paths_against_the_full_table():
    rng = random.Random(11)
    for size in [40] * 300 + [200] * 20:
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(0, size))) for _ in range(2))
        assert aligned_characters(a, b).tolist() == [-1 if x is None else x for x in walk(a, b)]


def test_runs_of_characters():
    assert runs("one two", "one xtwo") == [(0, 0, 4, True), (4, 5, 3, True)]
    assert runs("abcd", "abXd") == [(0, 0, 2, True), (2, 2, 1, False), (3, 3, 1, True)]
    assert runs("", "x") == runs("x", "") == []


def test_unlike_texts_take_little_memory():
    import tracemalloc

    rng = random.Random(3)
    a, b = ("".join(rng.choice(letters) for _ in range(6000)) for letters in ("abc", "xyz"))
    tracemalloc.start()
    aligned_characters(a, b)
    assert tracemalloc.get_traced_memory()[1] < 16 << 20  # the whole table has 144 MB
    tracemalloc.stop()


def ordered(spark, texts, *words_):
    found = ordered_candidates(values(spark, *texts), index_words(page(spark, *words_)), max_cer=0.9, max_edits=9)
    return sorted((r.region_id, r.start_word, r.end_word, r.edit_distance) for r in found.collect())


def test_ordered_spans(spark):
    assert ordered(spark, ["first", "second", "third"], "first", "inserted", "second", "third") == [(0, 0, 0, 0), (1, 2, 2, 0), (2, 3, 3, 0)]
    assert ordered(spark, [""], "first") == [] and ordered(spark, ["x"], "") == []
    # edits within words, a value over two words, and words of no value
    assert ordered(spark, ["Praha hlavni", "mesto", "1925"], "Prcha", "hlavnf", "-", "mesto", "rok", "1926") == [(0, 0, 1, 2), (1, 3, 3, 0), (2, 5, 5, 1)]
    # words at the edge go when the value is nearer without them
    assert ordered(spark, ["middle"], "x", "middle", "y") == [(0, 1, 1, 0)]


def test_diagnostics(spark):
    index, v = index_words(page(spark, "rome", "x", "rome")), values(spark, "rome", "rome", "rome")
    found = C.exact_candidates(v, index)
    chosen = S.selected(found)
    assert {r.region_id for r in S.ambiguous(found).collect()} == {0, 1, 2}
    assert {r.region_id for r in chosen.collect()} == {0, 1}
    assert {r.region_id for r in S.conflicted(found, chosen).collect()} == {2}


def test_normalisation():
    assert normalise(" ČESKÝ—Krumlov! ", ["lowercase", "strip-diacritics", "strip-punctuation"]) == "cesky krumlov"
    with pytest.raises(ValueError):
        TextAlignment(normalizers=["no such"]).values(None)


def test_options_are_checked():
    for bad in ({"max_cer": 2}, {"max_edits": -1}, {"max_starts": 0}):
        with pytest.raises(ValueError):
            C.Fuzzy(**bad)
    assert C.Fuzzy(max_edits=3).has_cliff and not C.Fuzzy().has_cliff
