"""Time inside sessions: active and idle time, waiting, artifact versions, turns by interval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACTIVE_GAP = 300_000  # milliseconds; longer gaps are idle


def active_time(events: DataFrame) -> DataFrame:
    """Per session: wall, active and idle milliseconds, and the widest gap."""
    w = Window.partitionBy("session_id").orderBy("occurred_at", "seq", "id")
    gap = F.timestamp_diff("MILLISECOND", F.lag("occurred_at").over(w), F.col("occurred_at"))
    rows = events.withColumn("gap", F.coalesce(gap, F.lit(0)))
    out = rows.groupBy("session_id").agg(
        F.sum("gap").cast("bigint").alias("wall_ms"),
        F.sum(F.when(F.col("gap") <= ACTIVE_GAP, F.col("gap")).otherwise(0)).cast("bigint").alias("active_ms"),
        F.max("gap").cast("bigint").alias("widest_ms"),
    )
    return out.withColumn("idle_ms", F.col("wall_ms") - F.col("active_ms"))


def interval_turns(messages: DataFrame) -> DataFrame:
    """A turn opens at each user message: its messages, answers and the last answer's id."""
    w = Window.partitionBy("session_id").orderBy("seq")
    rows = messages.withColumn("turn_index", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w))
    return rows.groupBy("session_id", "turn_index").agg(
        F.count("*").alias("messages"),
        F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).cast("bigint").alias("answers"),
        F.max_by(F.when(F.col("role") == "assistant", F.col("event_id")), F.when(F.col("role") == "assistant", F.col("seq"))).alias("final_event_id"),
    )


def waiting(events: DataFrame) -> DataFrame:
    """Seconds from an answer to the next event of its session, where that is a prompt."""
    w = Window.partitionBy("session_id").orderBy("occurred_at", "seq", "id")
    rows = events.withColumn("next_type", F.lead("type").over(w)).withColumn("next_at", F.lead("occurred_at").over(w))
    rows = rows.where("type = 'assistant_turn' and next_type = 'user_prompt'")
    return rows.select("session_id", "id", F.timestamp_diff("SECOND", F.col("occurred_at"), F.col("next_at")).cast("bigint").alias("waiting_seconds"))


def artifact_versions(changes: DataFrame) -> DataFrame:
    """Per (session, path): a version for each content that differs from the one before, the latest digest, first and last change."""
    w = Window.partitionBy("session_id", "path").orderBy("occurred_at", "seq", "id")
    before = F.lag("digest").over(w)
    rows = changes.withColumn("new", (before.isNull() | (before != F.col("digest"))).cast("bigint"))
    return rows.groupBy("session_id", "path").agg(
        F.sum("new").alias("versions"),
        F.max_by("digest", F.struct("occurred_at", "seq", "id")).alias("digest"),
        F.min("occurred_at").alias("first_at"),
        F.max("occurred_at").alias("last_at"),
    )


def lineage_owner(records: DataFrame, sessions: DataFrame) -> DataFrame:
    """For each (child session, record): the one earlier session of the same person that holds the record; none if several do."""
    found = records.join(sessions, "record_uuid").where("owner_email = child_email and owner_started <= child_started and owner_session <> child_session")
    return found.groupBy("child_session").agg(F.countDistinct("owner_session").alias("n"), F.min("owner_session").alias("parent_session")).where("n = 1").drop("n")
