"""Language-model scoring from a log-frequency Bloom filter.

Bigram counts are quantised to ``level = 1 + floor(log(count) / log(BASE))``, and
the filter holds the pairs (bigram, 1) ... (bigram, level). A worker finds a
bigram's level by probing upwards until a pair is missing; errors can only
raise a level, and the longer the run of pairs the less likely. The model is

    p(w | h) = low(h w) / (c(h) + MASS)              if h w was counted,
               MASS / (c(h) + MASS) * p(w)           otherwise,
    p(w)     = (1 - UNKNOWN) * c(w) / N + UNKNOWN / (V + 1),

with c the exact counts of tokens and ``low`` the least count of the bigram's
level, so that of any history the probabilities of all tokens and of the unknown
one sum to at most one, but for what false hits of the filter add.

The filter is sent to every worker, so its size is bounded by ``FILTER_BYTES``:
it holds the bigrams with counts of at least a cutoff, read off the histogram
of all counts so that they fit; ``HEAD`` tokens' counts are sent in the same
way. What lies below these cutoffs is looked up in the counts, a table in
buckets of its n-grams, by a join of the documents' n-grams. So no counted n-gram
is lost, what is gathered grows with the corpus, and a text's score depends on
the counts only, not on the filter's size. All counts are over all training
documents.

Defined results: a null text counts as empty and has one token, its end. Rows
that repeat an id are each scored (and each train). With no training text every
token is unknown, and N and V are zero: probabilities are then uniform over one
token. Only id and text are read. N-grams are told apart by 63-bit hashes.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphgrid.session import delete, discard, materialize, new_path, shuffles_removed, slices

#: Rows whose checksum of the id leaves this remainder never train.
FOLDS, HELD_OUT = 5, 1
HEAD = 300_000
FILTER_BYTES = 16 << 20
#: Bits for each pair in the filter: if all bigrams are in it, and if the rarest are not and a false hit takes several pairs.
BITS_ALL, BITS_SOME = 32, 16
#: Bits probed for a level, up to the cutoff's and above it.
PROBES, PROBES_ABOVE = 8, 4
BLOCK_BITS = 1 << 16
BASE = 1.5
#: Weight of the tokens' own distribution against a history's count, and the share of unknown tokens in it.
MASS, UNKNOWN = 100.0, 0.05
#: Words contain no blank, so this is no word's hash.
END = " "
#: Bytes of texts that are taken at a time, as what is made of their tokens takes many times their room.
PIECE_BYTES = 2 << 20
#: Rounds of probing, each with its share of the rows, so that only a part of what is looked up lies on disk at a time.
ROUNDS = 2
#: What the workers return. ``kind`` 0: an n-gram to look up, a token (times it stands there, and before another) or a bigram (times, its word's count, or the word
#: if that is to be looked up too). 1, or 2 if held out: a row's own sums, with tokens, known tokens, id, base and model.
SCORED = "row long, gram long, times int, past long, word long, a double, b double, kind tinyint"


def token_hash(words: list[bytes] | np.ndarray) -> np.ndarray:
    """64-bit hashes of lower-cased tokens; tokens are even, bigrams odd."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64) & ~np.uint64(1)


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts one after another: the different tokens' hashes, the end's last; which of them each token is; and how many tokens a text has.

    A text's tokens are its words, A-Z in lower case, and one end. Each word is hashed once, however often it stands there.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, size = split.flatten(), np.diff(np.asarray(split.offsets))
    there = np.asarray(pc.binary_length(words)) > 0  # blanks at a text's ends leave empty words
    if not there.all():
        size = np.bincount(np.repeat(np.arange(len(size)), size)[there], minlength=len(size))
        words = words.filter(pa.array(there))
    coded = words.dictionary_encode()
    some = np.append(token_hash(coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)), token_hash([END]))
    size = size.astype(np.int64) + 1
    which, is_end = np.full(int(size.sum()), len(some) - 1), np.zeros(int(size.sum()), np.bool_)
    is_end[np.cumsum(size) - 1] = True
    which[~is_end] = np.asarray(coded.indices)
    return some, which, size


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose last column is the text, a few rows and ``PIECE_BYTES`` of texts at a time, or one longer text."""
    for batch in slices(batches):
        upto = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0)), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PIECE_BYTES, "right")))
            yield batch.slice(at, end - at)
            at = end


def before(which: np.ndarray, size: np.ndarray, end: int) -> np.ndarray:
    """Which token stands before each one; before a text's first stands the end."""
    past = np.empty_like(which)
    past[1:] = which[:-1]
    past[np.cumsum(size) - size] = end
    return past


def coded_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of 64-bit keys, in order of their first places, and which of them each is."""
    coded = pa.array(keys.view(np.int64)).dictionary_encode()
    return np.asarray(coded.dictionary).view(keys.dtype), np.asarray(coded.indices).astype(np.int64)


def scrambled(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def bigrams(some: np.ndarray, which: np.ndarray, past: np.ndarray) -> np.ndarray:
    """The hash of each token with the one before it."""
    return (scrambled(some, 3)[past] + (some * np.uint64(0xBF58476D1CE4E5B9))[which]) | np.uint64(1)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out())


def counts(docs: DataFrame) -> DataFrame:
    """(gram, n): how often each token (even) and bigram (odd) occurs in the training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                gram, n = np.unique(np.concatenate(held), return_counts=True)
                for at in range(0, len(gram), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(gram[at : at + (1 << 16)].view(np.int64)), pa.array(n[at : at + (1 << 16)].astype(np.int64))], names=["gram", "n"])
            held.clear()

        for batch in pieces(batches):
            some, which, sizes = tokens_of(batch.column(0))
            held += [some[which], bigrams(some, which, before(which, sizes, len(some) - 1))]
            size += len(which)
            if size >= 4_000_000:
                yield from flush()
                size = 0
        yield from flush()

    trained = keyed(docs).filter(~F.col("held_out")).select("text")
    return trained.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def in_buckets(grams: DataFrame) -> tuple[DataFrame, str, str]:
    """``grams`` written in buckets of ``gram``, so that joins find them dealt; with the table's name and folder."""
    spark = grams.sparkSession
    name, path = f"glyphgrid_{uuid.uuid4().hex}", new_path(spark, "ngram-counts")
    with shuffles_removed(spark):
        grams.write.format("parquet").option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "gram").saveAsTable(name)
    return spark.table(name), name, path


class Filter:
    """A blocked log-frequency Bloom filter: all bits of an n-gram are in one block."""

    def __init__(self, blocks: int, lowest: int = 1, base: float = BASE, filled: bool = True):
        self.blocks, self.lowest, self.base = blocks, lowest, base
        self.bits = np.zeros(blocks * BLOCK_BITS // 64 if filled else 0, np.uint64)

    def probes(self, level: int) -> int:
        return PROBES if level <= self.lowest else PROBES_ABOVE

    def level(self, n: np.ndarray) -> np.ndarray:
        return 1 + np.floor(np.log(n) / math.log(self.base) + 1e-9).astype(np.int64)

    def low(self, level: np.ndarray) -> np.ndarray:
        """The least count of a level."""
        return np.ceil(self.base ** (level - 1.0) - 1e-6)

    def place(self, gram: np.ndarray) -> np.ndarray:
        return ((scrambled(gram, 17) >> np.uint64(32)) * np.uint64(self.blocks)) >> np.uint64(32)

    @staticmethod
    def walk(gram: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Where within its block the bits of a pair begin, and the step from one to the next."""
        h = scrambled(gram + np.full(1, level, np.uint64) * np.uint64(0x94D049BB133111EB), 29)
        return h, (h >> np.uint64(32)) | np.uint64(1)

    def block(self, gram: np.ndarray, n: np.ndarray) -> bytes:
        """The bits of one block that holds these n-grams."""
        level, bits = self.level(n), np.zeros(BLOCK_BITS, np.bool_)
        for k in range(1, int(level.max(initial=0)) + 1):
            h, step = self.walk(gram[level >= k], k)
            for _ in range(self.probes(k)):
                bits[(h & np.uint64(BLOCK_BITS - 1)).astype(np.int64)] = True
                h = h + step
        return np.packbits(bits, bitorder="little").tobytes()

    def find(self, gram: np.ndarray) -> np.ndarray:
        """The level of each n-gram, 0 below the lowest; what misses a bit is asked no further."""
        level, start = np.zeros(len(gram), np.int64), self.place(gram) * np.uint64(BLOCK_BITS)
        asked, k = np.arange(len(gram)), 0
        while len(asked) and self.blocks:
            k += 1
            at = start[asked]
            h, step = self.walk(gram[asked], k)
            for _ in range(self.probes(k)):
                bit = at + (h & np.uint64(BLOCK_BITS - 1))
                found = (self.bits[(bit >> np.uint64(6)).view(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                asked, at, step = asked[found], at[found], step[found]
                h = h[found] + step
            level[asked] = k
        level[level < self.lowest] = 0
        return level


def bucket(n: F.Column) -> F.Column:
    """A count, or for large ones the least count of its quarter of a doubling, so that histograms stay small."""
    return F.when(n < 1024, n).otherwise(F.floor(F.pow(F.lit(2.0), F.floor(F.log2(n) * 4) / 4)))


def cutoff_for(sizes: dict[int, int], most: int) -> tuple[int, int]:
    """The least bucket so that it and all above hold at most ``most``, and what they hold."""
    held, cutoff = 0, max(sizes, default=0) + 1
    for n in sorted(sizes, reverse=True):
        if held + sizes[n] > most:
            break
        held, cutoff = held + sizes[n], n
    return cutoff, held


def build_filter(pairs: DataFrame, sizes: dict[int, int], limit: int = FILTER_BYTES) -> tuple[Filter, int]:
    """The filter of all bigrams with at least the cutoff's count, and the cutoff; ``sizes``: levels held in each bucket of counts.

    Blocks are dealt to tasks and each is built where its n-grams are; only the
    bits, at most ``limit`` bytes, come to the driver.
    """
    bits = BITS_ALL
    cutoff, events = cutoff_for(sizes, limit * 8 // bits)
    if cutoff > 1:
        bits = BITS_SOME
        cutoff, events = cutoff_for({n: k for n, k in sizes.items() if n > 1}, limit * 8 // bits)
    blocks, lowest = -(-events * bits // BLOCK_BITS), 1 + math.floor(math.log(cutoff) / math.log(BASE) + 1e-9)
    made = Filter(blocks, lowest)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = Filter(blocks, lowest, filled=False)
        for batch in batches:
            block = empty.place(np.asarray(batch.column(0)).view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(block), *batch.columns], names=["block", "gram", "n"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = Filter(blocks, lowest, filled=False)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        name = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                gram, n = (np.concatenate(x) for x in zip(*held, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([empty.block(gram, n)], pa.binary())], names=["block", "bits"])
            held.clear()

        for batch in batches:
            block, gram, n = (np.asarray(c) for c in batch.columns)
            cut = np.concatenate(([0], np.nonzero(np.diff(block))[0] + 1, [len(block)]))
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if s < e:
                    if int(block[s]) != name:
                        yield from flush()
                        name = int(block[s])
                    held.append((gram[s:e].view(np.uint64), n[s:e]))
        yield from flush()

    kept = pairs.filter(bucket(F.col("n")) >= cutoff).select("gram", "n")
    dealt = kept.mapInArrow(place, "block long, gram long, n long").repartition("block").sortWithinPartitions("block")
    per_block = BLOCK_BITS // 64
    for r in dealt.mapInArrow(fill, "block long, bits binary").toLocalIterator():
        made.bits[r["block"] * per_block : (r["block"] + 1) * per_block] = np.frombuffer(bytes(r["bits"]), np.uint64)
    return made, cutoff


def score(docs: DataFrame, head: int = HEAD, limit: int = FILTER_BYTES, mass: float = MASS, unknown: float = UNKNOWN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    grams, table, folder = in_buckets(counts(docs))
    try:
        return scored(docs, grams, head, limit, mass, unknown)
    finally:  # whatever fails, no table stays in the caller's catalogue
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        delete(spark, folder)


def scored(docs: DataFrame, grams: DataFrame, head: int, limit: int, mass: float, unknown: float) -> DataFrame:
    """:func:`score` with the counts at hand."""
    spark = docs.sparkSession
    is_pair = F.col("gram").bitwiseAND(F.lit(1)) == 1
    level_of = lambda n: F.floor(F.log(n) / F.lit(math.log(BASE)) + F.lit(1e-9)) + 1
    sizes = grams.groupBy(is_pair.alias("pair"), bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(level_of(F.col("n"))).alias("levels")).collect()
    of_tokens = {r["bucket"]: r for r in sizes if not r["pair"]}
    total, distinct = sum(r["n"] for r in of_tokens.values()), sum(r["k"] for r in of_tokens.values())
    # the frequent tokens by a cutoff from the histogram, so that no task gathers the candidates of all
    rarest, _ = cutoff_for({n: r["k"] for n, r in of_tokens.items()}, head)
    frequent = grams.filter(~is_pair & (bucket(F.col("n")) >= rarest)).toArrow()
    first = np.asarray(frequent.column("gram").combine_chunks()).view(np.uint64) if frequent.num_rows else np.zeros(0, np.uint64)
    order = np.argsort(first)
    often = np.asarray(frequent.column("n").combine_chunks())[order] if frequent.num_rows else np.zeros(0, np.int64)
    made, least = build_filter(grams.filter(is_pair), {r["bucket"]: r["levels"] for r in sizes if r["pair"]}, limit)
    sent = spark.sparkContext.broadcast((first[order], often, made.blocks, made.lowest, made.bits))
    floor = total + 0.5 * (distinct + 1)
    # the tokens' own distribution: intercept and slope over counts
    share, slope = (unknown / (distinct + 1), (1 - unknown) / total) if total else (1.0, 0.0)
    all_pairs, all_tokens = least <= 1, rarest <= 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often_, blocks, lowest, bits = sent.value
        filter_ = Filter(blocks, lowest, filled=False)
        filter_.bits = bits
        nothing = lambda size: np.zeros(size, np.int64)
        for batch in pieces(batches):
            some, which, size = tokens_of(batch.column(3))
            rows, end = np.asarray(batch.column(0)), len(some) - 1
            owner, past = np.repeat(np.arange(len(size)), size), before(which, size, end)
            # each different token and bigram of the batch is looked up once; -1: a token that is not among the frequent
            at = np.minimum(np.searchsorted(known, some), max(len(known) - 1, 0))
            count = np.where(known[at] == some, often_[at], -1) if len(known) else np.full(len(some), -1)
            if all_tokens:
                count = np.maximum(count, 0)
            pair = bigrams(some, which, past)
            kinds, kind = coded_keys(pair)
            c_word, c_past = count[which], count[past]
            # a bigram is no more frequent than its tokens, and is not asked for if one is too rare for the filter
            most = np.empty(len(kinds), np.int64)
            most[kind] = np.minimum(c_word, c_past)
            level, asked = nothing(len(kinds)), np.nonzero((most < 0) | (most >= least))[0]
            level[asked] = filter_.find(kinds[asked])
            level = np.where(most < 0, level, np.minimum(level, filter_.level(np.maximum(most, 1))))
            held = level[kind]
            own = (np.log10(share + slope * np.maximum(count, 0)) + math.log10(mass))[which]
            found = np.log10(filter_.low(np.maximum(level, 1)))[kind]
            after = np.where(count >= 0, np.log10(np.maximum(count, 0) + mass), 0.0)[past]
            impossible = (c_word >= 0) & (c_past >= 0) & (np.minimum(c_word, c_past) < 1)  # a token of it was never seen
            settled = (held > 0) | ((impossible | all_pairs) & (c_word >= 0))
            said = np.where(held > 0, found, np.where(settled, own, 0.0)) - after
            model = np.bincount(owner, said, len(size))
            value = np.where(count >= 0, np.log10((np.maximum(count, 0) + 0.5) / floor), 0.0)
            base = np.bincount(owner, value[which], len(size))
            sure = np.bincount(owner, c_word > 0, len(size)).astype(np.int64)
            yield rows_of(rows, scrambled(rows.view(np.uint64), 41).view(np.int64), size, sure, batch.column(1), base, model, np.asarray(batch.column(2).cast(pa.int8())) + 1)
            # tokens that are not among the frequent, once a row: how often they stand there, and how often before a token
            rare, n_rare = np.nonzero(c_word < 0)[0], np.nonzero(c_past < 0)[0]
            if len(rare) or len(n_rare):
                each, back = coded_keys(np.concatenate((owner[rare] * len(some) + which[rare], owner[n_rare] * len(some) + past[n_rare])))
                times = np.bincount(back[: len(rare)], minlength=len(each))
                times_past = np.bincount(back[len(rare) :], minlength=len(each))
                zero = np.zeros(len(each))
                yield rows_of(rows[each // len(some)], some[each % len(some)].view(np.int64), times, times_past, nothing(len(each)), zero, zero, nothing(len(each)))
            # bigrams that the filter does not settle, once a row
            open_ = np.nonzero(~settled)[0]
            if len(open_):
                # a training row's bigrams were all counted, so that what an unseen one would add is not needed
                trains = ~np.asarray(batch.column(2).cast(pa.int8())).astype(np.bool_)
                each, back = coded_keys(owner[open_] * len(kinds) + kind[open_])
                times, one = np.bincount(back), np.empty(len(each), np.int64)
                one[back] = open_
                trained, c_word, zero = trains[owner[one]], c_word[one], np.zeros(len(one))
                word = np.where(trained | (c_word >= 0), np.uint64(0), some[which[one]])
                yield rows_of(rows[owner[one]], pair[one].view(np.int64), times, np.where(trained, 0, np.maximum(c_word, 0)), word.view(np.int64), zero, zero, nothing(len(one)))

    # of the counts, those that are not sent
    below = lambda least: F.lit(False) if least <= 1 else bucket(F.col("n")) < least
    others = grams.filter((is_pair & below(least)) | (~is_pair & below(rarest)))
    numbered = keyed(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    probed = lambda k: numbered.filter(F.col("row") % ROUNDS == k).mapInArrow(run, SCORED)
    joined = lambda k: probed(k).join(others, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    self_, token, pair, times = F.col("kind") > 0, (F.col("kind") == 0) & ~is_pair, (F.col("kind") == 0) & is_pair, F.col("times")
    seen = F.col("n") > 0
    # bigrams never counted, of a token that is not among the frequent: its own count is looked up below
    open_ = F.when(pair & ~seen, F.col("word")).otherwise(F.lit(0))
    own = lambda n: F.log10(F.lit(share) + F.lit(slope) * n) + F.lit(math.log10(mass))
    low = F.log10(F.ceil(F.pow(F.lit(BASE), level_of(F.col("n")) - 1) - F.lit(1e-6)))
    told = F.when(self_, F.col("b")).when(token, -F.col("past") * F.log10(F.col("n") + F.lit(mass))).when(seen, times * low).when(open_ == 0, times * own(F.col("past"))).otherwise(F.lit(0.0))
    mine = lambda c: F.when(self_, F.col(c))
    summed = lambda k: joined(k).groupBy("row", open_.alias("gram")).agg(
        F.max(mine("word")).alias("doc_id"),
        F.max(F.col("kind")).alias("kind"),
        F.max(mine("times")).cast("long").alias("n_tokens"),
        F.sum(F.when(self_, F.col("past")).when(token & seen, times).otherwise(0)).alias("n_known"),
        F.sum(F.when(token, times * F.log10((F.col("n") + 0.5) / F.lit(float(floor)))).otherwise(F.col("a"))).alias("base_score"),
        F.sum(told).alias("score"),
        F.sum(times).alias("times"),
    )
    # one round's probes are gone before those of the next are written
    rounds = [materialize(summed(k), "scores") for k in range(ROUNDS)]
    sums = reduce(DataFrame.unionByName, rounds)
    words = sums.filter("gram <> 0").select("row", "gram", "times").join(others, "gram", "left")
    rest = words.groupBy("row").agg(F.sum(F.col("times") * own(F.coalesce("n", F.lit(0)))).alias("rest"))
    done = materialize(
        sums.filter("gram = 0").join(rest, "row", "left").select(
            "doc_id", (F.col("kind") == 2).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
            "base_score", (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"),
        ),
        "scored",
    )
    discard(*rounds)
    return done


def rows_of(row: np.ndarray, gram: np.ndarray, times: np.ndarray, past: np.ndarray, word: np.ndarray | pa.Array, a: np.ndarray, b: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    """A batch of ``SCORED``."""
    columns = [pa.array(row, pa.int64()), pa.array(gram, pa.int64()), pa.array(times.astype(np.int32)), pa.array(past, pa.int64()), word if isinstance(word, pa.Array) else pa.array(word, pa.int64())]
    return pa.RecordBatch.from_arrays([*columns, pa.array(a, pa.float64()), pa.array(b, pa.float64()), pa.array(kind.astype(np.int8))], names=[x.split()[0] for x in SCORED.split(", ")])
