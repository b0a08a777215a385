"""SimHash, substrings, language model, WARC and language identification against brute force."""

import collections
import hashlib
import math
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from glyphgrid.llm import bloom_lm, components, langid, simhash, substring_dedup, warc

ODD = ["", None, " ", "one", "one two", "A b C", "a b c", "x " * 5000]


def docs(spark, texts, **more):
    rows = [(k, t, "clash", "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, fp string")


def classes(codes, radius):
    label = list(range(len(codes)))
    changed = True
    while changed:
        changed = False
        for i in range(len(codes)):
            for j in range(i):
                if bin(codes[i] ^ codes[j]).count("1") <= radius and label[i] != label[j]:
                    low, high = sorted((label[i], label[j]))
                    label = [low if x == high else x for x in label]
                    changed = True
    return label


def test_gray_index_links_all_and_only_near_codes():
    rng = random.Random(3)
    for size in (1, 2, 33, 300):
        seeds = [rng.getrandbits(64) for _ in range(max(1, size // 6))]
        codes = []
        while len(codes) < size:
            c = rng.choice(seeds)
            for _ in range(rng.randrange(0, 6)):
                c ^= 1 << rng.randrange(64)
            if c not in codes:
                codes.append(c)
        rank = lambda c: [c := c ^ c >> k for k in (1, 2, 4, 8, 16, 32)][-1]
        codes.sort(key=rank)
        got = simhash.GrayIndex(np.array(codes, np.uint64), 3).link()
        assert got.tolist() == classes(codes, 3)


def reference_fp(text, k=3):
    words = (text or "").encode().lower().split()
    k = min(k, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("most", [10**6, 4])
def test_near_duplicates(spark, most):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(200)] for _ in range(12)]
    texts = list(ODD)
    for _ in range(60):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    fps = [reference_fp(t) for t in texts]
    want = classes(fps, 3)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, texts), most=most).collect()}
    assert [got[k].fingerprint for k in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[k].component_id for k in range(len(texts))] == want


def test_near_duplicates_odd_tables(spark):
    df = spark.createDataFrame([(5, "same words here now"), (5, "same words here now"), (None, "same words here now"), (None, "alone in this text")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(df).collect() if r.component_id is not None) == [(-1, 5), (5, 5), (5, 5)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    pairs += [(5000 - k % 3, 6000 + k) for k in range(2500)]  # hubs
    label = {x: x for p in pairs if p[0] != p[1] for x in p}
    for a, b in pairs * 2:
        if a != b:
            low, high = sorted((label[a], label[b]))
            label = {x: low if y == high else y for x, y in label.items()}
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == label


def removed_words(texts, span):
    first, out = {}, []
    for k, t in enumerate(texts):
        w = (t or "").encode().split()
        cover = [False] * len(w)
        for i in range(len(w) - span + 1):
            if first.setdefault(tuple(w[i : i + span]), k) < k:
                cover[i : i + span] = [True] * span
        kept = b" ".join(x for x, c in zip(w, cover) if not c)
        out.append((len(w), sum(cover), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("span,anchor", [(50, 8), (6, 3)])
def test_substrings(spark, span, anchor):
    rng = random.Random(span)
    passages = [[f"p{k}.{i}" for i in range(span + rng.randrange(-2, 40))] for k in range(4)]
    texts = [*ODD, " ".join(["same"] * 300), " ".join(["same"] * 200)]
    for _ in range(50):
        words = []
        for _ in range(rng.randrange(1, 4)):
            words += [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(0, 30))]
            p = rng.choice(passages)
            cut = rng.randrange(0, 5)
            words += p[cut : len(p) - rng.randrange(0, 5)]
        texts.append(" ".join(words))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.without_duplicates(docs(spark, texts), span, anchor).collect()}
    assert [got[k] for k in range(len(texts))] == removed_words(texts, span)


def test_substrings_odd_tables(spark):
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.without_duplicates(df).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 60)]
    assert substring_dedup.without_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("head", [3, 10**6])
def test_base_scores(spark, head):
    rng = random.Random(2)
    texts = ODD + [" ".join(f"T{int(rng.expovariate(0.2))}" for _ in range(rng.randrange(0, 60))) for _ in range(80)]
    tokens = [(t or "").encode().lower().split() + [None] for t in texts]
    c = collections.Counter()
    for k, w in enumerate(tokens):
        if zlib.crc32(str(k).encode()) % 5 != 1:
            c.update(w)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in bloom_lm.score(docs(spark, texts), head=head).collect()}
    for k, w in enumerate(tokens):
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(k).encode()) % 5 == 1, len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)
        assert r.score < 0
    held = [k for k in got if got[k].held_out and len(tokens[k]) > 10]
    assert sum(got[k].score for k in held) > sum(got[k].base_score for k in held) * 1.2


def test_filter_never_loses_a_gram_and_seldom_invents_one():
    rng = np.random.default_rng(1)
    grams, n = rng.integers(0, 2**63, 20000).astype(np.uint64), rng.integers(2, 500, 20000)
    levels = bloom_lm.Filter(1).level(n)
    f = bloom_lm.Filter(int(levels.sum()) * bloom_lm.BITS_SOME // bloom_lm.BLOCK_BITS + 1, lowest=2)
    place = f.place(grams).astype(int)
    per = bloom_lm.BLOCK_BITS // 64
    for b in range(f.blocks):
        f.bits[b * per : (b + 1) * per] = np.frombuffer(f.block(grams[place == b], n[place == b]), np.uint64)
    found = f.find(grams)
    assert (found >= levels).all() and (found == levels).mean() > 0.99
    assert (f.find(rng.integers(0, 2**63, 1_000_000).astype(np.uint64)) > 0).mean() < 2e-5


def test_scores_of_odd_tables(spark):
    df = spark.createDataFrame([(1, None), (1, "a"), (None, "b c")], "doc_id long, text string")
    assert sorted(r.n_tokens for r in bloom_lm.score(df).collect()) == [1, 2, 3]
    assert bloom_lm.score(df.limit(0)).count() == 0


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip_and_lookup(spark):
    big = "é" * 600
    rows = [(k, f"http://WWW.Site{k % 7}.example.com:80/a/{k}?q={k}", h) for k, h in enumerate([None, "", "small", "small", big, big, big, "x" * 1000, "line\r\n\r\nend" * 200, "🎉" * 400])]
    rows += [(100 + k, f"https://many.example.org/{k % 5}", f"body {k}") for k in range(60)] + [(None, None, "no id")]
    folder, archive = warc.write(pages(spark, rows), block_lines=7)
    got = {r.page_id: r for r in warc.lookup(folder, archive, pages(spark, rows)).collect()}
    assert len(got) == len(rows)
    for k, url, html in rows:
        data = (html or "").encode()
        same = [i for i, _, h in rows if h == html and i is not None]
        revisit = len(data) >= 1000 and max(same) != k
        r = got[k]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None)
        assert revisit or r.payload == (html or "")
    assert archive.directory.count() > 5
    wanted = ["https://many.example.org/3", rows[4][1], "http://nowhere.example/", "https://many.example.org/3"]
    urls = spark.createDataFrame([(u,) for u in wanted], "url string")
    expect = sorted(k for k, u, _ in rows if u in wanted)
    assert sorted(r.page_id for r in warc.lookup(folder, archive, urls).collect()) == expect


def test_a_url_of_very_many_captures_lies_in_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_LINES", 20)
    rows = [(k, "http://hot.example/" if k % 3 else f"http://h{k}.example/", f"text {k}") for k in range(200)]
    folder, archive = warc.write(pages(spark, rows), block_lines=7)
    assert archive.directory.filter("first_key = 'example,hot)/' AND last_key = first_key").select("part").distinct().count() > 3
    found = warc.lookup(folder, archive, pages(spark, rows).withColumns({n: F.lit("clash") for n in ("key", "part", "kind")}))
    assert found.rdd.getNumPartitions() > 5 and sorted(r.page_id for r in found.collect()) == list(range(200))
    assert sorted(r.page_id for r in warc.lookup(folder, archive, spark.createDataFrame([("http://hot.example/",)], "url string")).collect()) == [k for k in range(200) if k % 3]


def test_warc_odd_tables(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0
    twice = pages(spark, [(7, "u", "z" * 2000), (7, "u", "z" * 2000), (3, "u", "z" * 2000)])
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(twice).collect()) == [(3, "revisit", 7), (7, "response", None), (7, "response", None)]


def test_url_keys():
    assert warc.url_key("https://User@B.a.Example.COM:8080/x/y?q=1#f") == "com,example,a,b)/x/y?q=1"
    assert (warc.url_key(None), warc.url_key("http://h"), warc.url_key("not a url")) == ("", "h)/", "not a url")


def parse_by_hand(sample, text):
    """Phrases of a greedy parse by substring search."""
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        n, at = n + 1, at + size
    return n


def squeezed(t):
    return " ".join(t.split(" ")) if "  " not in t else squeezed(t.replace("  ", " "))


@pytest.mark.parametrize("room", [langid.TABLE_BYTES, 1])
def test_phrases_against_substring_search(room, monkeypatch):
    monkeypatch.setattr(langid, "TABLE_BYTES", room)
    rng = random.Random(6)
    for size in [200] * 12 + [5000] * 3:
        sample = "".join(rng.choice("abcd ") for _ in range(200))
        p = langid.Parser((("x", sample),))
        texts = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(1, size))) for _ in range(5)]
        got = p.phrases([p.symbols(t) for t in texts])[:, 0].tolist()
        assert got == [parse_by_hand(squeezed(sample), squeezed(t)) for t in texts]


def test_a_long_part_of_the_sample_is_one_phrase():
    rng = random.Random(9)
    sample = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    p = langid.Parser((("x", sample), ("y", sample[::-1])))
    assert p.phrases([p.symbols(squeezed(sample)[4000:9000].strip())])[0, 0] == 1


def test_languages_of_thousands_of_letters(monkeypatch):
    monkeypatch.setattr(langid, "TABLE_BYTES", 1 << 20)
    rng = random.Random(10)
    one, two = [chr(c) for c in range(0x4E00, 0x5600)], [chr(c) for c in range(0x5400, 0x5C00)]
    write = lambda signs, n: "".join(signs[min(int(rng.expovariate(0.004)), len(signs) - 1)] for _ in range(n))
    p = langid.Parser((("en", "the quick brown fox " * 200), ("one", write(one, 20_000)), ("two", write(two, 20_000))))
    texts = [write(one, 400), write(two, 400), "a lazy brown dog and the fox", write(one, 3000)]
    assert [x for x, _ in p.predict(texts)] == ["one", "two", "en", "one"]
    sample, text = write(one, 3000), write(one, 1500)
    q = langid.Parser((("one", sample),))
    assert q.languages[0].table is None and q.phrases([q.symbols(text)])[0, 0] == parse_by_hand(sample, text)


def test_languages(spark):
    rng = random.Random(4)
    parts = {"aa": ["tion", "the", "ing", "er"], "bb": ["que", "ment", "é", "oi"]}
    rows = [(k, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(40)), lang) for k in range(120) for lang in [rng.choice(["aa", "bb"])]]
    odd = [(1000, None, "aa"), (1001, "123 456 !!", "bb"), (1002, "", None), (1003, "the tion ing", None), (1003, "the tion ing", None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = langid.identify(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + len(odd)
    assert all(by[k].lang_pred == lang and 0 < by[k].score <= 1 for k, _, lang in rows)
    assert [by[k].lang_pred for k in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"]
    assert langid.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(df.filter("doc_id >= 1000 AND lang IS NULL")).collect()} == {"und"}


def test_word_hashes_tell_words_apart():
    rng = random.Random(12)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))).encode() for _ in range(5000)}
    data = b" \t".join(sorted(words)) + b"\n"
    hashes = substring_dedup.WordHashes()
    for half in hashes.of(data):
        assert len(set(half.tolist())) == len(words)
    assert hashes.of(b"x  " + data)[1][1:].tolist() == hashes.of(data)[1].tolist() == substring_dedup.WordHashes().of(data)[1].tolist()
    assert hashes.of(b" \t")[0].size == 0


def test_words_that_collide_under_polynomials_are_different(spark):
    """Thue-Morse words of equal polynomials modulo 2**64 to every odd base; and windows of words of a MB."""
    morse = "a"
    while len(morse) < 4096:
        morse += morse.translate(str.maketrans("ab", "ba"))
    other, rest = morse.translate(str.maketrans("ab", "ba")), " ".join(f"w{k}" for k in range(49))
    long_ = " ".join(["x" * 1_000_000] + [f"v{k}" for k in range(49)])
    texts = [f"{morse} {rest}", f"{other} {rest}", f"{other} {rest}", long_, long_]
    got = {r.doc_id: r.n_removed for r in substring_dedup.without_duplicates(docs(spark, texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 50, 3: 0, 4: 50}


def jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in (a, b))]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def similar_groups(texts, least=0.8):
    """For each text the smallest of its group: connected by pairs as similar as asked."""
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if label[a] != label[b] and jaccard(texts[a], texts[b]) >= least:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return {k: x for k, x in enumerate(label) if k != x}


def test_copies_by_similarity(spark):
    rng = random.Random(21)
    vocabulary = [f"w{k}" for k in range(2000)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(150)) for _ in range(15)]
    for k in range(45):
        words = rng.choice(texts[:15]).split()
        for _ in range(rng.choice([1, 2, 3, 12])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += ["a b", "b a", "", "a b c d e f g", "a b c d e f g h"]
    df = docs(spark, texts)
    gone = {r.doc_id: r.kept_id for r in simhash.similar_copies(df).collect()}
    assert gone == similar_groups(texts) and len(gone) > 20
    left = simhash.drop_similar_copies(df.union(spark.createDataFrame([(None, texts[0], "clash", "clash")], df.schema)))
    assert left.columns == df.columns and left.count() == len(texts) - len(gone) + 1
    assert simhash.similar_copies(df.limit(0)).count() == 0


def test_repeated_rows_and_empty_texts_are_copies(spark):
    rows = [(4, "some words of a text that is here twice"), (4, "some words of a text that is here twice"), (7, "some words of a text that is here twice"), (8, None), (9, ""), (None, "")]
    gone = {(r.doc_id, r.kept_id) for r in simhash.similar_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert gone == {(7, 4), (9, 8)}


@pytest.mark.parametrize("together", [simhash.TOGETHER, 1500])
def test_copies_among_texts_that_share_a_passage(spark, together, monkeypatch):
    monkeypatch.setattr(simhash, "TOGETHER", together)
    rng = random.Random(31)
    vocabulary = [f"w{k}" for k in range(4000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = some(100)
    texts = [passage + some(rng.randrange(30, 60)) for _ in range(60)]  # buckets of the passage hold texts that are no copies
    for k in rng.sample(range(60), 30):
        texts.append(texts[k][:-4] + some(2))
    texts = [" ".join(w) for w in texts]
    assert {r.doc_id: r.kept_id for r in simhash.similar_copies(docs(spark, texts)).collect()} == similar_groups(texts)


def test_large_buckets_lose_no_pair(spark, monkeypatch):
    """However few members all are compared with at first, what a bucket holds is linked."""
    monkeypatch.setattr(simhash, "TOGETHER", 0)
    monkeypatch.setattr(simhash, "REPS", 0)
    monkeypatch.setattr(simhash, "DIVIDED_BY", 32, raising=False)
    rng = random.Random(41)
    passage, some = [f"p{k}" for k in range(60)], lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    texts = [passage + some(rng.randrange(20, 40)) for _ in range(20)]
    for k in rng.sample(range(20), 10):
        texts.append(texts[k][:-4] + some(2))
    texts = [" ".join(w) for w in texts]
    assert {r.doc_id: r.kept_id for r in simhash.similar_copies(docs(spark, texts)).collect()} == similar_groups(texts)


def test_pairs_of_a_bucket_share_a_rare_shingle(spark):
    rng = random.Random(43)
    sets = [sorted(rng.sample(range(40), rng.randrange(1, 30))) for _ in range(60)]
    sets += [sorted({*s, rng.randrange(40)} - {rng.choice(s)}) or [1] for s in sets]
    df = spark.createDataFrame([(1, k, k, k % 3 > 0, s) for k, s in enumerate(sets)], "key long, doc_id long, component long, asks boolean, s array<long>")
    found = {(r.doc, r.rep) for r in simhash.sharing_pairs(df, 0.8).collect()}
    like = {(a, b) for a in range(len(sets)) for b in range(a) if (a % 3 or b % 3) and len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))}
    assert len(like) > 20 and like <= found


def test_cut_and_appended_copies_are_found(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [some(rng.randrange(100, 300)) for _ in range(100)]
    for words in list(texts):
        n = len(words)
        k = rng.randrange(n * 11 // 100, n * 18 // 100)
        texts.append(words[:-k] if len(texts) % 2 else words + some(k))
    texts = [" ".join(w) for w in texts]
    gone = {r.doc_id: r.kept_id for r in simhash.similar_copies(docs(spark, texts)).collect()}
    assert gone == similar_groups(texts) and len(gone) > 80


def lm_corpus():
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(600)]
    texts = [" ".join(vocabulary[min(int(rng.paretovariate(0.7)) - 1, 599)] for _ in range(rng.randrange(5, 80))) for _ in range(150)] + ODD
    tokens = [(t or "").lower().split() + [" "] for t in texts]
    ones, twos = collections.Counter(), collections.Counter()
    for k, w in enumerate(tokens):
        if zlib.crc32(str(k).encode()) % 5 != 1:
            ones.update(w)
            twos.update(zip([" "] + w, w))
    f, total = bloom_lm.Filter(1), sum(ones.values())

    def probability(past, word):
        n, own = twos[past, word], (1 - bloom_lm.UNKNOWN) * ones[word] / total + bloom_lm.UNKNOWN / (len(ones) + 1)
        return (float(f.low(f.level(np.array([n])))[0]) if n else bloom_lm.MASS * own) / (ones[past] + bloom_lm.MASS)

    return texts, tokens, ones, probability


def test_probabilities_of_all_tokens_are_at_most_one():
    _, _, ones, probability = lm_corpus()
    for past in [" ", "w0", "w1", "w17", "never seen"]:
        whole = sum(probability(past, w) for w in ones) + probability(past, "unknown")
        assert 0.5 < whole <= 1 + 1e-9
    assert sum(probability("never seen", w) for w in [*ones, "unknown"]) == pytest.approx(1)


@pytest.mark.parametrize("head,limit", [(20, 0), (0, 300), (20, 1500), (20, bloom_lm.FILTER_BYTES), (bloom_lm.HEAD, bloom_lm.FILTER_BYTES), (bloom_lm.HEAD, 0)])
def test_scores_against_the_counts_whatever_is_sent(spark, head, limit):
    texts, tokens, ones, probability = lm_corpus()
    expected = [sum(math.log10(probability(past, word)) for past, word in zip([" "] + w, w)) for w in tokens]
    got = {r.doc_id: r for r in bloom_lm.score(docs(spark, texts), head=head, limit=limit).collect()}
    near = sum(got[k].score == pytest.approx(x, rel=1e-6) for k, x in enumerate(expected))
    # hits of the filter may raise a level
    assert near >= (1.0 if limit == 0 else 0.9) * len(texts)
    assert sum(got[k].score for k in got) == pytest.approx(sum(expected), rel=0.002)


def test_a_row_without_an_id_links_others(spark, monkeypatch):
    codes = {1: 0b0, None: 0b11100, 2: 0b11111100, 9: 0xFFFF0000}  # the null row is the only bridge from 1 to 2
    frame = spark.createDataFrame([(k, c) for k, c in codes.items()] + [(None, 0xFFFF0001), (None, 0x7FFF000000000000)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, shingle: frame)
    got = sorted((r.fingerprint, r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(frame).collect())
    assert got == [("0000000000000000", 1, 1), ("000000000000001c", -1, 1), ("00000000000000fc", 2, 1), ("00000000ffff0000", 9, 9), ("00000000ffff0001", -1, 9), ("7fff000000000000", -1, None)]


def test_long_repetitive_texts_are_one_pass(monkeypatch):
    rng = random.Random(1)
    samples = tuple({"aa": " ".join(rng.choice(["tion", "the", "aaa", "aaaaaa"]) for _ in range(3000)), "bb": " ".join(rng.choice(["que", "ment", "ab"]) for _ in range(3000))}.items())
    p = langid.Parser(samples)

    def by_hand(g, sequence):
        state = n = 0
        for c in g.local[sequence].tolist():
            to = int(g.step(np.array([state]), np.array([c]))[0])
            n, state = n + (to & 1), to >> 1
        return n

    texts = ["a" * 5000, "the " * 700 + "a" * 3000, "ab" * 2000, "", "zz", "aaa que " * 400]
    for room in (langid.TABLE_BYTES, 1):  # in tables and in lists
        monkeypatch.setattr(langid, "TABLE_BYTES", room)
        p = langid.Parser(samples)
        sequences = [p.symbols(t) for t in texts]
        assert p.phrases(sequences).tolist() == [[by_hand(g, s) for g in p.languages] for s in sequences]
    began = time.time()
    langid.Parser(samples).predict(["a" * 2_000_000])
    assert time.time() - began < 60


def test_tokens_are_split_as_the_contract_says_and_each_is_hashed_once(monkeypatch):
    texts = [*ODD, None, "", " ", "a  B\ta\x0bb\x0ca\rb\n", "\x1c x\x1dy \x00 \xa0z É é", "É" * 3000, "a " * 5000]
    hashed, digest = [], bloom_lm.xxhash.xxh3_64_digest
    monkeypatch.setattr(bloom_lm.xxhash, "xxh3_64_digest", lambda word: hashed.append(word) or digest(word))
    column = pa.array(["left out", *texts], pa.string()).slice(1)
    some, which, size = bloom_lm.tokens_of(column)
    words = [(t or "").encode().lower().split() for t in texts]
    assert size.tolist() == [len(w) + 1 for w in words] and len(set(some.tolist())) == len(some)
    assert sorted(w for w in hashed if w != bloom_lm.END) == sorted({w for text in words for w in text})
    expected = [int.from_bytes(digest(w), "big") & ~1 for text in words for w in [*text, bloom_lm.END]]
    assert some[which].tolist() == expected
    past = [e for text in words for e in [bloom_lm.END, *text]]
    assert some[bloom_lm.before(which, size, len(some) - 1)].tolist() == [int.from_bytes(digest(w), "big") & ~1 for w in past]


def test_tokens_cost_little_more_than_splitting():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"Word{k:x}" for k in row) for row in np.minimum(rng.zipf(1.2, (512, 512)), 10**7).tolist()]
    column = pa.array(texts)

    def seconds(work):
        took = []
        for _ in range(5):
            began = time.process_time()
            work()
            took.append(time.process_time() - began)
        return min(took)

    def hashed():
        for batch in (column.slice(0, 256), column.slice(256)):
            some, which, size = bloom_lm.tokens_of(batch)
            bloom_lm.bigrams(some, which, bloom_lm.before(which, size, len(some) - 1))

    # 2.5 times as long; 8 when each word was looked up in a dictionary of Python
    assert seconds(hashed) < 5 * seconds(lambda: [t.encode().lower().split() for t in texts])


def test_long_texts_are_taken_a_few_at_a_time(monkeypatch):
    monkeypatch.setattr(bloom_lm, "PIECE_BYTES", 100)
    texts = ["a" * 60, None, "b" * 40, "c", "d" * 500, "", "é" * 50, "e"] + [None] * 600
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["row", "text"])
    got = list(bloom_lm.pieces([whole.slice(0, 0), whole, whole.slice(3, 2)]))
    assert [r for b in got for r in b.column(0).to_pylist()] == [*range(len(texts)), 3, 4]
    assert [b.num_rows for b in got[:4]] == [3, 1, 1, 2]
    assert all(b.num_rows == 1 or sum(len((t or "").encode()) for t in b.column(1).to_pylist()) <= 100 for b in got)
