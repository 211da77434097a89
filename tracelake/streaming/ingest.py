"""Structured Streaming: landed event files into the event table, sessions refolded as they change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import merge
from ..sources.records import EVENT, verdict

_PATH = "_part"
KEYS = ["agent_id", "prompt_id", "tool_use_id", "model"]


def apply_batch(batch: DataFrame, events_path: str, rejected_path: str, batch_id: int) -> None:
    """One micro-batch: accepted items go to the events, each id once, others to the rejected.

    The event table keeps every version that arrived, so a batch never reads
    it; `events` has one row per id.  Written under the batch's number, so a
    batch that runs again replaces itself.
    """
    judged = batch.withColumn("reason", verdict())
    good = judged.where("reason is null").drop("reason", "_corrupt_record").withColumn("day", F.to_date(F.try_to_timestamp("occurred_at")))
    merge.collapsed(good).withColumn(_PATH, F.lit(batch_id)).write.partitionBy(_PATH).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(events_path)
    judged.where("reason is not null").withColumn(_PATH, F.lit(batch_id)).write.partitionBy(_PATH).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(rejected_path)


def events(spark: SparkSession, events_path: str) -> DataFrame:
    """The event table as it stands: per id the highest version, whichever batch brought it."""
    return merge.current(spark.read.parquet(events_path), KEYS, _PATH)


def start(spark: SparkSession, landing: str, events_path: str, rejected_path: str, checkpoint: str) -> StreamingQuery:
    """Everything that has landed, then stop; run again for what lands later."""
    stream = spark.readStream.schema(EVENT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(landing)
    return stream.writeStream.foreachBatch(lambda batch, i: apply_batch(batch, events_path, rejected_path, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per type and window, on a stream or a table; rows later than `late` are dropped by a stream."""
    rows = events.withColumn("at", F.col("occurred_at").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", window), "type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("since"), "type", "n")
