"""The queries op1 to op10 over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embedspace.llm import bpe, exact_dedup, line_dedup, lm_scoring, packing, quality_rules, simhash, substring_dedup, toxicity, url_filter

#: Vocabulary files are never copied; their folder's module names the place.
PACKING_VOCABULARY = "word_bpe_49k.json"
BPE_VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.UrlRules(url_filter.RULES).judge(pages).select("page_id", "host", "path", "rule", "verdict")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate_once(table(spark, sf_dir, "documents"))


def packing_config() -> packing.PackingConfig:
    import public_tokenizers

    return packing.PackingConfig(public_tokenizers.path(PACKING_VOCABULARY))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing_config())


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_digests(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_VOCABULARY), public_tokenizers.PATTERN)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_changes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("new_text", F.lit("")), 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_quality_rules, op2_url_filter, op3_exact_dedup, op4_packing, op5_simhash,
    op6_substring_dedup, op7_lm_scoring, op8_byte_bpe, op9_line_dedup, op10_toxicity,
)}

ORACLES: dict[str, str] = {
    "op1_quality_rules": quality_rules.oracle(), "op2_url_filter": url_filter.ORACLE, "op3_exact_dedup": exact_dedup.ORACLE,
    "op6_substring_dedup": substring_dedup.ORACLE, "op9_line_dedup": line_dedup.oracle(),
}
