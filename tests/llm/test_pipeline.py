"""The pipeline on a small corpus, stage by stage, against what each stage should do."""

import hashlib
import random

from pyspark.sql import functions as F

import corpus_pipeline
from glyphgrid.llm import mixing
from glyphgrid.llm.sentencepiece_codec import Codec, model_bytes


def corpus(spark):
    rng = random.Random(3)
    parts = {"aa": ["tion", "the", "ing", "er", "ous"], "bb": ["que", "ment", "é", "oi", "ça"]}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 6))) for _ in range(n))
    rows = [(k, text(lang, 120), lang, f"s{k % 3}", 0) for k in range(60) for lang in [rng.choice(["aa", "bb"])]]
    rows += [(100 + k, rows[k][1].upper() if k % 2 and rows[k][2] == "aa" else rows[k][1], rows[k][2], "s0", 0) for k in range(10)]  # exact copies
    for k in range(20, 30):  # near copies
        words = rows[k][1].split()
        words[50] = "changed"
        rows.append((200 + k, " ".join(words), None, None, None))
    rows += [(300, None, "aa", "s1", 0), (301, "123 ... 456", "bb", "s1", 0), (302, "", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, tmp_path):
    docs = corpus(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        path = str(tmp_path / name)
        now.write.parquet(path)
        now = spark.read.parquet(path)
        kept[name] = {r.doc_id for r in now.collect()}
        if name != "sentencepiece":
            assert now.columns == docs.columns
    everyone = {r.doc_id for r in docs.collect()}
    assert everyone - kept["language_id"] == {300, 301, 302}
    assert kept["language_id"] - kept["exact_dedup"] == set(range(10))
    assert kept["exact_dedup"] - kept["simhash"] == set(range(220, 230))
    assert kept["mixing"] == kept["simhash"] == kept["sentencepiece"]
    own = {r.doc_id: r.lang for r in spark.read.parquet(str(tmp_path / "mixing")).collect()}
    assert all(own[r.doc_id] == r.lang for r in docs.filter("lang IS NOT NULL").collect() if r.doc_id in own)
    model = Codec(model_bytes(corpus_pipeline.tokenizer())).model
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in now.collect():
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, model.encode(texts[r.doc_id], add_eos=True))).encode()).hexdigest()
    assert sorted(corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(now.collect())


def test_odd_rows_pass_every_stage(spark, tmp_path):
    """Null ids, repeated rows, ties, empty and very long texts, and columns with the names the operators use inside."""
    long_ = " ".join(f"word{k}" for k in range(60_000))
    rows = [(1, "one small text", "s"), (1, "one small text", "s"), (None, "no id here", None), (None, "no id here", None), (5, long_, "s"), (6, long_ + " end", "t"), (7, "", "t"), (8, None, "t"), (9, "ONE small text", "u")]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({n: F.lit("clash") for n in ("row", "key", "rep", "doc", "slot", "place", "order", "component", "s", "n", "salt", "recipe", "norm", "fp", "bands")})
    docs = docs.withColumns({n: F.lit("clash") for n in ("id", "kept", "sha", "gone", "at", "__sha", "__id", "__kept", "__at", "__row", "__file", "__n", "__gone", "__before", "file", "ahead")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert name == "sentencepiece" or now.columns == docs.columns
        kept.append(sorted((r.doc_id or 0) for r in now.collect()))
    assert kept == [[0, 0, 1, 1, 5, 6, 9], [0, 5, 6, 9], [0, 5, 9], [0, 5, 9], [0, 5, 9]]
    assert sorted(r.position for r in now.collect()) == [0, 1, 2]


def test_empty(spark, tmp_path):
    corpus(spark).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_positions_follow_the_schedule(spark, tmp_path):
    sources = {k: "abc"[min(2, k % 7)] for k in range(400)}
    docs = spark.createDataFrame([(k, f"text {k}", s) for k, s in sources.items()], "doc_id long, text string, source string")
    mixed = str(tmp_path / "mixed")
    mixing.in_mixed_order(docs).write.option("maxRecordsPerFile", 17).parquet(mixed)
    got = {r.doc_id: r.position for r in corpus_pipeline.encoded(spark, spark.read.parquet(mixed), str(tmp_path)).collect()}
    # earliest deadline first, block by block
    weight = {r.source: r.weight for r in mixing.source_weights(docs.groupBy("source").agg(F.count("*").alias("n"))).collect()}
    order = {r.doc_id: r.h % 2**64 >> 1 for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    queues = {s: sorted((k for k in sources if sources[k] == s), key=order.get) for s in weight}
    period, size, had, expect, t = sum(weight.values()), mixing.BLOCK, dict.fromkeys(weight, 0), [], 0
    while len(expect) < len(sources):
        ready = [(-(-(had[s] + 1) * period // w), (had[s] + 1) * period % w == 0, -w, s) for s, w in weight.items() if had[s] * period // w <= t]
        s = min(ready)[-1]
        expect += queues[s][had[s] * size : (had[s] + 1) * size]
        had[s], t = had[s] + 1, t + 1
    assert sorted(got, key=got.get) == expect and sorted(got.values()) == list(range(400))


def test_positions_follow_the_numbers_of_files(spark, tmp_path):
    """Names of six digits come after those of five, though not as texts; columns stay, whatever they are called."""
    docs = spark.createDataFrame([(k, f"text {k}", "s") for k in range(6)], "doc_id long, text string, source string").withColumns({n: F.col("doc_id") for n in ("file", "row", "ahead", "__row")})
    for k, number in enumerate(("00007", "99999", "100000")):
        docs.filter(F.col("doc_id").between(2 * k, 2 * k + 1)).coalesce(1).sortWithinPartitions("doc_id").write.parquet(str(tmp_path / number))
        [part] = (tmp_path / number).glob("part-*.parquet")
        (tmp_path / "all").mkdir(exist_ok=True)
        part.rename(tmp_path / "all" / f"part-{number}-x.parquet")
    out = mixing.in_file_order(spark.read.parquet(str(tmp_path / "all")))
    assert {r.doc_id: r.position for r in out.collect()} == {k: k for k in range(6)}
    assert out.columns == [*docs.columns, "position"]
