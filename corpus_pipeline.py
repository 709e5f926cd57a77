"""A corpus cleaned, deduplicated, mixed and encoded: five stages over the documents table.

Every stage takes any rows with the columns of documents: nulls in any column, empty and very long texts, repeated
rows, ids that are shared or missing, further columns of any name (which stay, but for those that the last stage
replaces), and no rows at all, of which it returns none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readloom.llm import bpe, line_dedup, mixing, quality, simhash
from readloom.llm.common import cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the base rules or the classifier reject.

    Null and empty texts have no words and go; equal rows fare alike, whatever their ids; without usable labels of
    both classes the base rules decide alone."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that match an earlier line; every document stays, if only with an empty text.

    Null texts stay null, lines without a word stay; rows without an id come first; of rows that share an id (or have
    none), equal ones are one document, and others are in the order of their texts' hashes."""
    return line_dedup.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: the one with the smallest id.

    Null, empty and blank texts are copies of each other; equal rows with the smallest id all stay; of a group without
    ids one row stays, that of the least hash of the text."""
    return simhash.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that sources come near their target weights.

    Null and empty texts have no words and go; a null source is a source of its own; rows of one id share their draw,
    and rows without an id draw by their texts."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add each document's token ids (``ids``) and what they decode to (``decoded``), in place of columns of these names.

    Null and empty texts have no ids; equal texts have equal ids."""
    return bpe.encode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: The classifier and the encoder have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
