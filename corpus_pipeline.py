"""The corpus pipeline: quality rules, near duplicates, repeated passages, benchmark passages, tokens."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import bpe, decontamination, jaccard_join, quality_rules, substring_dedup
from tracelake.llm.runtime import delete, lean, recorded, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []


def _stage(function: Stage) -> Stage:
    """What the stage before has stored for itself is deleted: its result is written when the next begins."""

    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        lean(spark)
        delete(spark, _left)
        _left.clear()
        with recorded() as paths:
            out = function(spark, docs, sf_dir)
        _left.extend(paths)
        return out

    return run


@_stage
def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.passing(docs)


@_stage
def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity of 0.8 or more."""
    return jaccard_join.deduplicated(docs, n=5, numerator=80, denominator=100)


@_stage
def _passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has go; n_chars follows the text."""
    out = substring_dedup.dedupe(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


@_stage
def _benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontamination.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each remaining document's number of tokens, and digests of its tokens and of their decoding."""
    return bpe.digests(docs, keep=["doc_id"])


STAGES = [
    ("quality_rules", _quality),
    ("near_duplicates", _near_duplicates),
    ("substring_dedup", _passages),
    ("decontamination", _benchmark),
    ("bpe", _tokens),
]

#: Stages one, two, three and five are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written as Parquet and read again by the next."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        with recorded() as paths:
            docs = stored(out, name)
        delete(spark, last)
        last = paths
    return STAGES[-1][1](spark, docs, sf_dir)
