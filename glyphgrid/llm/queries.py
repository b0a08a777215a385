"""The operators of this subpackage applied to whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphgrid.llm import bloom_lm, byte_bpe, exact_dedup, langid, merkle, mixing, quality, secrets, sentencepiece_codec, simhash, substring_dedup, variants, warc
from glyphgrid.session import read_table

#: The vocabulary file of the first query; callers may pass the path of another.
VOCABULARY = "piece_bpe_32k.model"
RANKS = "byte_bpe_multi_50k.tiktoken"

#: SQL: the table of CRC-32, and the checksum of a list of bytes by it.
CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS r(i)
)"""
CRC = "xor(list_reduce(list_prepend(4294967295, {bytes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def tokenizer(name: str = VOCABULARY) -> str:
    """Where a vocabulary file of the public tokenizers lies on the driver."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sentencepiece_codec(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    return sentencepiece_codec.digests(read_table(spark, sf_dir, "documents"), sentencepiece_codec.model_bytes(model_path or tokenizer()))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_duplicates(read_table(spark, sf_dir, "documents"))


def op5_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score(read_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op9_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(read_table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    import public_tokenizers

    ranks = byte_bpe.rank_bytes(ranks_path or tokenizer(RANKS))
    return byte_bpe.digests(read_table(spark, sf_dir, "documents"), ranks, pattern or public_tokenizers.PATTERN)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(read_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece_codec": op1_sentencepiece_codec,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_simhash": op3_simhash,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_bloom_lm": op5_bloom_lm,
        "op6_warc": op6_warc,
        "op7_quality_rules": op7_quality_rules,
        "op8_language_id": op8_language_id,
        "op9_pfair_mixing": op9_pfair_mixing,
        "op10_secret_scan": op10_secret_scan,
        "op11_byte_bpe": op11_byte_bpe,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
""",
        "op4_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), t AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d
), k AS (
  SELECT doc_id, p, md5(string_agg(word, ' ') OVER fifty) AS h, count(*) OVER fifty AS n FROM t
  WINDOW fifty AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)
), f AS (
  SELECT h, min(doc_id) AS least FROM k WHERE n = 50 GROUP BY h
), dup AS (
  SELECT k.doc_id, k.p FROM k JOIN f ON k.h = f.h WHERE n = 50 AND least < k.doc_id
), c AS (
  SELECT t.doc_id, t.p, t.word, max(dup.p) OVER (PARTITION BY t.doc_id ORDER BY t.p ROWS UNBOUNDED PRECEDING) >= t.p - 49 AS covered
  FROM t LEFT JOIN dup ON t.doc_id = dup.doc_id AND t.p = dup.p
), s AS (
  SELECT doc_id, count_if(coalesce(covered, false)) AS removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT coalesce(covered, false)) AS kept FROM c GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s ON d.doc_id = s.doc_id
""",
        "op6_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), g AS (
  SELECT h, max(page_id) AS first_id FROM p WHERE strlen(h) >= 1000 GROUP BY h
)
SELECT p.page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN g.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.first_id <> p.page_id THEN g.first_id END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h
""",
        "op12_spelling_variants": f"""
WITH {CRC_TABLE}, runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]{{6,}}')) AS run
  FROM documents
), per AS (
  SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS x FROM runs GROUP BY id, run
), hashed AS (
  SELECT run, n, {CRC.format(bytes="list_transform(range(1, len(x), 2), lambda k: CAST('0x' || x[k:k + 1] AS BIGINT))")} AS h FROM per, crc_table
), w AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM hashed GROUP BY word HAVING sum(n) >= 5 AND length(word) >= 6
), cut AS (
  SELECT word, n, unnest(range(length(word))) AS k FROM w
), gap AS (
  SELECT word, n, k, left(word, k) || substr(word, k + 2) AS rest FROM cut
), pair AS (
  SELECT g.word, w.word AS other, w.n AS other_n FROM gap AS g JOIN w ON g.rest = w.word
  UNION SELECT w.word, g.word, g.n FROM gap AS g JOIN w ON g.rest = w.word
  UNION SELECT a.word, b.word, b.n FROM gap AS a JOIN gap AS b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
), near AS (
  SELECT word, count(*) AS n_near, max(other_n) AS best_n, arg_min(other, (-other_n, encode(other))) AS best FROM pair GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n
  FROM w LEFT JOIN near ON w.word = near.word
), far AS (
  WITH RECURSIVE follow(word, last, steps) AS (
    SELECT word, word, 0 FROM formed
    UNION ALL SELECT follow.word, form, steps + 1 FROM follow JOIN formed ON follow.last = formed.word WHERE form IS NOT NULL
  )
  SELECT word, arg_max(last, steps) AS root FROM follow GROUP BY word
)
SELECT formed.word, form, root, n, n_near, form_n FROM formed JOIN far ON formed.word = far.word
""",
        "op13_merkle_manifest": f"""
WITH RECURSIVE {CRC_TABLE}, fields AS (
  SELECT doc_id, lang, n_chars,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    {CRC.format(bytes="list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c))")} % 7 = 0 AS hit
  FROM documents, crc_table
), leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree,
    sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen(CAST(n_chars + CAST(coalesce(hit, false) AS BIGINT) AS VARCHAR)) || ':' || (n_chars + CAST(coalesce(hit, false) AS BIGINT)), '-') || tail) AS tampered
  FROM fields
), nodes(tree, level, place, digest, n) AS (
  SELECT tree, 0, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1, leaf, count(*) OVER (PARTITION BY tree) FROM leaves
  UNION ALL
  SELECT tree, level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (any_value(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY tree, level, place // 2
), tops(level, place, digest, n, tree) AS (
  SELECT 0, row_number() OVER (ORDER BY encode(tree)) - 1, digest, count(*) OVER (), tree FROM nodes WHERE n = 1
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (any_value(n) + 1) // 2, NULL FROM tops WHERE n > 1 GROUP BY level, place // 2
), low(doc_id, leaf, tree, level, place, digest, others, n) AS (
  SELECT doc_id, leaf, tree, 0, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1, tampered, '', count(*) OVER (PARTITION BY tree) FROM leaves
  UNION ALL
  SELECT l.doc_id, l.leaf, l.tree, l.level + 1, l.place // 2,
    sha256(CASE WHEN s.digest IS NULL THEN l.digest WHEN l.place % 2 = 0 THEN l.digest || s.digest ELSE s.digest || l.digest END), l.others || coalesce(s.digest, ''), (l.n + 1) // 2
  FROM low AS l LEFT JOIN nodes AS s ON l.tree = s.tree AND l.level = s.level AND xor(l.place, 1) = s.place WHERE l.n > 1
), high(doc_id, leaf, subroot, level, place, digest, others, n) AS (
  SELECT l.doc_id, l.leaf, t.digest, 0, t.place, l.digest, l.others, t.n FROM low AS l JOIN tops AS t ON l.tree = t.tree WHERE l.n = 1
  UNION ALL
  SELECT h.doc_id, h.leaf, h.subroot, h.level + 1, h.place // 2,
    sha256(CASE WHEN s.digest IS NULL THEN h.digest WHEN h.place % 2 = 0 THEN h.digest || s.digest ELSE s.digest || h.digest END), h.others || coalesce(s.digest, ''), (h.n + 1) // 2
  FROM high AS h LEFT JOIN tops AS s ON h.level = s.level AND xor(h.place, 1) = s.place WHERE h.n > 1
)
SELECT h.doc_id, h.leaf, h.subroot, r.digest AS root, sha256(h.others) AS proof_sha256, h.digest AS folded_root, h.digest = r.digest AS verified
FROM high AS h, (SELECT digest FROM tops WHERE n = 1) AS r WHERE h.n = 1
""",
    }
