"""Effective-dated prices and turn cost, in whole micro-dollars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rate_intervals(prices: DataFrame) -> DataFrame:
    """Each rate with the time it holds: the first of a model reaches back without end, as usage before any rate takes the earliest."""
    order = Window.partitionBy("model").orderBy("effective_from")
    rows = prices.withColumn("valid_to", F.lead("effective_from").over(order))
    return rows.withColumn("valid_from", F.when(F.row_number().over(order) > 1, F.col("effective_from")))


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage with micro_dollars; a model without any rate costs 0.

    The join is on the model with a range beside it; Spark broadcasts the price list while it is small.
    """
    rates = rate_intervals(prices).withColumnRenamed("model", "rate_model")
    on = (F.col("model") == F.col("rate_model")) & (F.col("valid_from").isNull() | (F.col("occurred_at") >= F.col("valid_from"))) & (F.col("valid_to").isNull() | (F.col("occurred_at") < F.col("valid_to")))
    rows = usage.join(rates, on, "left")
    cost = F.coalesce(F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price"), F.lit(0)).cast("bigint")
    return rows.withColumn("micro_dollars", cost).drop("rate_model", "valid_from", "valid_to", "effective_from", "input_price", "output_price")


def current_rates(prices: DataFrame, at) -> DataFrame:
    """Per model the rate that holds at a time."""
    rows = prices.where(F.col("effective_from") <= F.lit(at))
    return rows.groupBy("model").agg(F.max_by(F.struct("input_price", "output_price"), "effective_from").alias("r")).select("model", "r.*")


def turn_cost(turns: DataFrame, ledger: DataFrame, prices: DataFrame) -> DataFrame:
    """Per turn the tokens and cost of its messages."""
    return turns.join(priced(ledger, prices), "message_id").groupBy("session_id", "turn_index").agg(F.sum("input_tokens").cast("bigint").alias("input_tokens"), F.sum("micro_dollars").cast("bigint").alias("micro_dollars"))


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage with micro_dollars, the cache's tokens included: reads and the two kinds of writes cost multiples of the input price.

    prices has cache_read, write_5m and write_1h beside the rates.  Where the
    split of the writes is not known (both 0), cache_creation counts as the
    shorter kind.  A synthetic or unknown model costs 0.
    """
    rates = rate_intervals(prices).withColumnRenamed("model", "rate_model")
    on = (F.col("model") == F.col("rate_model")) & (F.col("valid_from").isNull() | (F.col("occurred_at") >= F.col("valid_from"))) & (F.col("valid_to").isNull() | (F.col("occurred_at") < F.col("valid_to")))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(20,0)")
    bare = (n("ephemeral_5m") == 0) & (n("ephemeral_1h") == 0)
    short = F.when(bare, n("cache_creation")).otherwise(n("ephemeral_5m"))
    rate = lambda c: F.col(c).cast("decimal(8,4)")
    cached = n("cache_read") * rate("read_rate") + short * rate("write_5m_rate") + n("ephemeral_1h") * rate("write_1h_rate")
    cost = (n("input_tokens") + cached) * F.col("input_price") + n("output_tokens") * F.col("output_price")
    priced_ = F.when(F.col("rate_model").isNull() | (F.col("model") == "<synthetic>"), F.lit(0)).otherwise(F.round(cost, 0))
    return usage.join(rates, on, "left").withColumn("micro_dollars", priced_.cast("bigint")).select(*usage.columns, "micro_dollars")


def spend(rows: DataFrame, by: list[str]) -> DataFrame:
    """Priced and unpriced rows: those with tokens and no cost were never priced, those without tokens never spent anything."""
    spent = F.col("tokens") > 0
    return rows.groupBy(*by).agg(
        F.count_if(F.col("micro_dollars") > 0).alias("priced"), F.count_if(spent & (F.coalesce("micro_dollars", F.lit(0)) == 0)).alias("unpriced"),
        F.sum(F.coalesce("micro_dollars", F.lit(0))).cast("bigint").alias("micro_dollars"), F.sum(F.when(F.coalesce("micro_dollars", F.lit(0)) == 0, F.col("tokens")).otherwise(0)).cast("bigint").alias("unpriced_tokens"),
    )


def models_used(answers: DataFrame) -> DataFrame:
    """Per session its models, each once, in the order in which they were first seen; synthetic ones are none."""
    first = answers.where("model is not null and model not in ('', '<synthetic>')").groupBy("session_id", "model").agg(F.min(F.struct("occurred_at", "seq")).alias("at"))
    return first.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "model"))), lambda x: x["model"]), ",").alias("models"))
