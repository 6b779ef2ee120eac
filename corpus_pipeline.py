"""A training corpus from documents: quality rules, line dedup, near-dedup, substring dedup, packing.

Edge cases, for every stage: a null text counts as empty, a null doc_id comes after all others. Columns that a stage
doesn't read are passed on, whatever their names; n_chars, where there is one, follows the text. An empty table stays
empty. Very long texts are worked on whole. What each stage makes of repeated rows and ties is said below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from embedspace.llm.common import materialize
from embedspace.llm.line_dedup import line_dedup
from embedspace.llm.packing import pack
from embedspace.llm.quality_rules import quality_filter
from embedspace.llm.queries import packing_config
from embedspace.llm.simhash_wide import keep_representatives
from embedspace.llm.substring_dedup import substring_dedup

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and short texts go; repeated rows stay or go alike; a value on a fence is within it."""
    return quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many sites share, which stay in the smallest doc_id alone, in all of its rows. Null texts stay null."""
    return line_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group whose five-word shingles have a similarity of 0.8 or more, directly or by way of others: that of the smallest
    doc_id, then of the smallest key of its text. Rows that share a doc_id but not the text are judged each by its own. Of repeated rows one stays. Texts
    without a word are one group."""
    return keep_representatives(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words that one with a smaller doc_id has; rows that share a doc_id lose nothing to each other. What is
    left of a text keeps its spaces, but for one space where a passage went. Null texts stay null."""
    return substring_dedup(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a null text has its end token alone, repeated rows are packed each by itself."""
    return pack(docs, packing_config())


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("passages", passages), ("packing", packing)]

#: Neither fingerprints nor packing can be had from SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = materialize(docs) if i < len(STAGES) - 1 else docs
    return docs
