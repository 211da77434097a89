"""Idempotent ingest: duplicates, versions, the usage ledger and the session rollup.

Arrival order is not in the data; it is (ingested_at, id) where a rule needs one,
given by the caller as a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The order of session types in a merge (the largest wins).
TYPE_RANK = {"empty": 0, "user": 1, "internal": 2, "automation": 3}


def type_rank(c: Column) -> Column:
    return F.coalesce(*[F.when(c == t, F.lit(r)) for t, r in TYPE_RANK.items()])


def merged_type(c: Column) -> Column:
    """Aggregate of the session types of one session: automation over internal over user over empty."""
    m = F.max(type_rank(c))
    return F.coalesce(*[F.when(m == r, F.lit(t)) for t, r in TYPE_RANK.items()])


def new_events(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of the batch whose id is not stored yet, each id once (the highest version): the rows that move counters."""
    return collapsed(batch).join(stored.select("id"), "id", "left_anti")


def collapsed(batch: DataFrame) -> DataFrame:
    """Each id of a batch once: the highest version, of equal ones the first."""
    w = Window.partitionBy("id").orderBy(F.col("capture_version").desc(), "seq")
    return batch.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def upserted(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The stored events with a batch merged in by id.

    A higher version replaces the row, a lower or equal one does not; the key
    columns of either side fill each other's gaps, the batch's going first.
    """
    rows = stored.withColumn("_late", F.lit(0)).unionByName(collapsed(batch).withColumn("_late", F.lit(1)))
    return current(rows, keys, "_late")


def current(rows: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """One row per id of a table that holds every version: the highest, of equal ones the first to arrive; key columns from the last arrival that has them."""
    w = Window.partitionBy("id")
    last = w.orderBy(F.col(arrival)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(last) for c in keys})
    return rows.withColumn("rn", F.row_number().over(w.orderBy(F.col("capture_version").desc(), arrival))).where("rn = 1").drop("rn", arrival)


IDENTITY = ("session_id", "agent_id", "record_uuid", "type", "tool_use_id")


def rekeyed(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Transcript rows that are a stored record under another id take the stored id (the least, if several match)."""
    named = lambda df: [F.coalesce(F.col(c), F.lit("")).alias(f"_{c}") for c in IDENTITY]
    known = stored.where("origin = 'transcript' and record_uuid is not null").select(*named(stored), "id").groupBy(*[f"_{c}" for c in IDENTITY]).agg(F.min("id").alias("_id"))
    rows = batch.select("*", *named(batch)).join(known, [f"_{c}" for c in IDENTITY], "left")
    moved = (F.col("origin") == "transcript") & F.col("record_uuid").isNotNull()
    return rows.withColumn("id", F.when(moved, F.coalesce("_id", "id")).otherwise(F.col("id"))).select(*batch.columns)


def claimed(events: DataFrame, arrival: list[str]) -> DataFrame:
    """(session_id, email, started_at): the person whose event arrived first owns a session, and it starts with the least of that person's times."""
    first = events.groupBy("session_id").agg(F.min_by("email", F.struct(*arrival)).alias("owner"))
    mine = events.join(first, "session_id").where(F.col("email") == F.col("owner"))
    return mine.groupBy("session_id", "email").agg(F.min("occurred_at").alias("started_at"))


def versioned(rows: DataFrame, keys: list[str], version: str, fill: list[str]) -> DataFrame:
    """One row per key: the highest version's, whose null `fill` columns come from the next version that has them."""
    order = Window.partitionBy(*keys).orderBy(F.col(version).desc())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = rows.withColumns({c: F.first(c, ignorenulls=True).over(whole) for c in fill})
    return filled.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def usage_key(message_id: Column, event_id: Column) -> Column:
    """A message counts once under its own id; without one, or with one over 256 bytes, under its event's."""
    return F.when(message_id.isNotNull() & (message_id != "") & (F.octet_length(message_id) <= 256), message_id).otherwise(F.concat(F.lit("event:"), event_id))


def first_writer(rows: DataFrame, key: str, arrival: list[str]) -> DataFrame:
    """The row that arrived first for each key."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*arrival))).where("rn = 1").drop("rn")


def counters_added(a: Column, b: Column) -> Column:
    """Two maps of counts, added key by key."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def rollup(events: DataFrame) -> DataFrame:
    """One row per session from its events: bounds, counters, distinct versions, newest non-null by arrival (seq)."""
    count = lambda *types: F.sum(F.when(F.col("type").isin(*types), 1).otherwise(0)).cast("bigint")
    return events.groupBy("session_id").agg(
        F.min("occurred_at").alias("started_at"),
        F.max("occurred_at").alias("ended_at"),
        count("user_prompt").alias("user_turns"),
        count("tool_call").alias("tool_calls"),
        count("tool_failed").alias("errors"),
        count("file_changed").alias("files"),
        F.sum("tokens").cast("bigint").alias("tokens"),
        F.array_join(F.array_sort(F.collect_set("origin")), ",").alias("origins"),
        F.max_by("type", "seq").alias("last_type"),
        F.min_by("type", "seq").alias("first_type"),
    )


def combined(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Two rollups as one; the same as the rollup of both their events."""
    both = old.withColumn("part", F.lit(0)).unionByName(delta.withColumn("part", F.lit(1)))
    return both.groupBy("session_id").agg(
        F.min("started_at").alias("started_at"),
        F.max("ended_at").alias("ended_at"),
        *[F.sum(c).cast("bigint").alias(c) for c in ("user_turns", "tool_calls", "errors", "files", "tokens")],
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("origins", ","))))), ",").alias("origins"),
        F.max_by("last_type", "part").alias("last_type"),
        F.min_by("first_type", "part").alias("first_type"),
    )


def empty_kind(ended: Column, reason: Column, seconds: Column) -> Column:
    """An ended session without content is blank if its prompt was left or it lasted five seconds, else aborted."""
    return F.when(~ended, F.lit(None)).when((reason == "prompt_input_exit") | (seconds >= 5), "blank").otherwise("aborted")
