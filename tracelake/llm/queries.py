"""The registered queries of this subpackage: thin, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontamination, html_extract, jaccard_join, quality_classifier, quality_rules, sharding, substring_dedup, suffix_dedup, warc
from .runtime import lean


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture, revisits resolved to the responses they stand for."""
    found = warc.resolve(warc.capture_log(_table(spark, sf_dir, "pages")))
    return found.select("record_id", "canonical_url", "status", "base_id", "validator", warc.header_text(found["merged_headers"]).alias("headers"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, plain limits and the robust outlier verdict of every document."""
    return quality_rules.judged(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-word windows that an earlier one has."""
    return substring_dedup.digests(_table(spark, sf_dir, "documents"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extracted(_table(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items of the benchmark found in every document."""
    return decontamination.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under 4-shingle Jaccard of 0.85 or more."""
    return jaccard_join.joined(_table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak-label posterior and trained score of every document."""
    return quality_classifier.scored(_table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and their decoding, as digests."""
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform shuffle of all documents into 16 shards."""
    return sharding.digests(_table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 100-byte strings that start earlier."""
    return suffix_dedup.digests(_table(spark, sf_dir, "documents"))


_ALL = (
    op1_warc_revisits,
    op2_quality_rules,
    op3_substring_dedup,
    op4_html_extract,
    op5_decontamination,
    op6_jaccard_join,
    op7_quality_classifier,
    op8_bpe,
    op9_sharding,
    op10_suffix_dedup,
)
QUERIES = {f.__name__: f for f in _ALL}

ORACLE_SQL: dict[str, str] = {"op1_warc_revisits": warc.ORACLE}
