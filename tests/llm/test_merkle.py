"""The manifest against a tree built level by level, for blocks of several sizes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from glyphgrid.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climb(nodes):
    """(root, for every node its siblings as (before, after))."""
    steps, groups, now = [[] for _ in nodes], [[k] for k in range(len(nodes))], list(nodes)
    while len(now) > 1:
        above, held = [], []
        for k in range(0, len(now), 2):
            left, right = now[k], now[k + 1] if k + 1 < len(now) else ""
            for i in groups[k]:
                steps[i].append(("", right))
            for i in groups[k + 1] if right else []:
                steps[i].append((left, ""))
            above.append(H(left + right))
            held.append(groups[k] + (groups[k + 1] if right else []))
        now, groups = above, held
    return now[0], steps


def brute(rows):
    def leaf(doc_id, source, lang, n_chars, text, more=0):
        values = [doc_id, source, lang, n_chars if n_chars is None else n_chars + more, text]
        return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((-1 if r[0] is None else r[0], leaf(*r), r))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    lower = {x: climb([leaf for _, leaf, _ in sorted(trees[x], key=lambda y: y[:2])]) for x in langs}
    root, upper = climb([lower[x][0] for x in langs])
    out = []
    for x, way in zip(langs, upper):
        for (_, own, r), steps in zip(sorted(trees[x], key=lambda y: y[:2]), lower[x][1]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            digest = leaf(*r, more=int(hit))
            for before, after in steps + way:
                digest = H(before + digest + after)
            out.append((r[0], own, lower[x][0], root, H("".join(a + b for a, b in steps + way)), digest, digest == root))
    return sorted(out, key=repr)


def found(docs, levels):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r) for r in merkle.manifest(docs, levels).select(*names).collect()), key=repr)


@pytest.mark.parametrize("levels", [1, 3, 10])
def test_manifest_equals_the_tree(spark, levels):
    rng = random.Random(levels)
    rows = [(k, rng.choice(["a", "é", None]), "en" if rng.random() < 0.6 else rng.choice(["de", "zz", "Ä", ""]), rng.choice([0, 7, None, -3]), "x" * rng.randint(0, 40)) for k in range(150)]
    rows += [(None, None, None, None, None), (None, "a", "x", 3, "t"), (5, "a", "en", 3, "t"), (5, "a", "en", 3, "t"), (5, "a", "en", 4, "é" * 100_000), (7, "b", None, 7, "q")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({n: F.lit(1) for n in ("tree", "place", "size", "digest", "above")})
    want = brute(rows)
    assert found(docs, levels) == want
    assert {r[-1] for r in want} == {True, False}


@pytest.mark.parametrize("rows", [[], [(1, "s", "en", 4, "text")], [(k, None, None, None, None) for k in (1, 1, 1)]])
def test_small_tables(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    assert found(docs, 10) == (brute(rows) if rows else [])


def test_whole_result_of_the_walk_in_one_block():
    digests = [H(str(k)) for k in range(11)]
    siblings = [[] for _ in digests]
    assert merkle.walk(digests, 0, 11, 4, siblings) == climb(digests)[0]
    want = [[(b"\0" + bytes.fromhex(a)) if a else (b"\1" + bytes.fromhex(b)) if b else b"" for a, b in steps] for steps in climb(digests)[1]]
    assert siblings == want
