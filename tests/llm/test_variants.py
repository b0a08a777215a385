"""Spelling variants against all pairs of deletion neighbourhoods."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from glyphgrid.llm import variants


def brute(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(variants.UPPER, variants.LOWER))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            k = h % len(run)
            count[run[:k] + run[k + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}

    def edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [v for v in words if edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 5 * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


def found(docs):
    return sorted(tuple(r) for r in variants.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect())


def sample():
    rng = random.Random(3)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 9))) for _ in range(250)]
    words += ["a" * k for k in range(6, 12)] + ["b" + "×" * 6, "÷ÀÀÀÀÀ", "aaaaab", "aaaaaç"]
    weights = [1 + (k % 17) ** 3 for k in range(len(words))]
    rows = [(k, "; ".join(rng.choices(words, weights, k=300)).title() if k % 3 else " ".join(rng.choices(words, weights, k=200))) for k in range(50)]
    long = ["a" * 2000, "a" * 2001, "a" * 1000 + "b" + "a" * 1000, "a" * 1999 + "c"]
    rows.append((77, "kettles " * 6 + "kettlez " * 40 + "kettlxz " * 300))
    return rows + [(900 + k, " ".join(long)) for k in range(6)] + [(None, None), (None, "Abcdef " * 40), (3, ""), (3, "abcdef abcdeg " * 7)]


def test_whole_results_whatever_the_size_of_shards(spark, monkeypatch):
    rows = sample()
    want = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit("x"), "form": F.lit(0.5)})
    assert any(r[1] is not None and r[2] != r[1] for r in want)
    assert found(docs) == want
    monkeypatch.setattr(variants, "SHARD_BYTES", 600)
    monkeypatch.setattr(variants, "WAVE_BYTES", 20000)
    assert found(docs) == want


def test_equal_counts_take_the_smaller_form(spark):
    text = "planets " * 5 + "planéts " * 40 + "planats " * 40
    assert ("planets", "planats", "planats", 5, 2, 40) in found(spark.createDataFrame([(1, text)], "doc_id long, text string"))


def test_tables_without_words(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []
    assert found(spark.createDataFrame([(1, None), (2, "short words only")], "doc_id long, text string")) == []


def test_very_long_words_take_time_in_proportion():
    a = "a" * 500_000
    words = sorted([a + a, a + a + "a", a + "b" + a, a + a[1:]])
    trie = variants.Trie.unpacked(variants.Trie(words, [1, 2, 3, 4]).packed())
    near = {w: sorted(words[k] for k in trie.neighbours(w)) for w in words}
    assert near[a + a] == sorted([a + a + "a", a + "b" + a, a + a[1:]])
    assert near[a + a + "a"] == sorted([a + a, a + "b" + a]) and near[a + a[1:]] == [a + a]
