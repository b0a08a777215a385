"""A training corpus from the raw documents, stage by stage.

Every stage takes all that its predecessor kept. The stages drop documents
without a recognisable language, exact copies and near copies (candidates by
SimHash and minima, linked if at least 0.8 of their five-word shingles are in
common; of each group of links one document stays), put the rest in the order of
the mix, and encode it.

Columns of other names than those read (doc_id, text, lang, source) are passed on
up to the mix, whatever they are called. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphgrid.llm import exact_dedup, langid, mixing, sentencepiece_codec, simhash
from glyphgrid.llm.queries import tokenizer
from glyphgrid.session import materialize, read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``lang`` becomes the predicted language; texts that are null or have no letter go, so empty ones too.

    Rows are judged one by one, with or without an id, repeated or not.
    """
    return langid.relabelled(docs, langid.sample(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row with the largest id stays, one only if rows repeat it; null ids are smaller than all others."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near copies, linked by five-word similarity of 0.8 or more, the smallest id stays.

    Rows with one id are one document and stay or go together; rows without an
    id stay, and so does a text without a copy, however long or short.
    """
    return simhash.drop_similar_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix; null sources are one source, rows that repeat an id are placed next to each other."""
    return mixing.in_mixed_order(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and the decoded text, and each document's ``position`` in the mix.

    ``docs`` must be the mixed files as they were written. Every row gets its
    own position; null and empty texts have the end id alone.
    """
    return sentencepiece_codec.digests(mixing.in_file_order(docs), sentencepiece_codec.model_bytes(tokenizer()), keep=("position",))


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash", near), ("mixing", mixed), ("sentencepiece", encoded)]

#: The first stage learns from text, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
