"""Sources: batches of events as JSON, transcripts as lines, vendor dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT = "id string, session_id string, type string, source string, origin string, seq long, occurred_at string, capture_version int, agent_id string, prompt_id string, tool_use_id string, text string, model string, raw string, _corrupt_record string"
#: The types of events and the versions that are accepted.
TYPES = ("session_started", "session_ended", "user_prompt", "assistant_turn", "tool_call", "tool_result", "tool_failed", "file_changed", "subagent_start", "subagent_end", "compaction", "artifact")
CAPTURE_VERSIONS = (0, 4)


def verdict() -> Column:
    """Why an item is rejected for good; null: accepted."""
    low, high = CAPTURE_VERSIONS
    return (
        F.when(F.col("_corrupt_record").isNotNull(), "bad payload")
        .when(F.coalesce("id", F.lit("")) == "", "missing id")
        .when(F.coalesce("session_id", F.lit("")) == "", "missing session_id")
        .when(~F.coalesce(F.col("type").isin(*TYPES), F.lit(False)) | F.col("source").isNull() | F.col("origin").isNull() | F.try_to_timestamp("occurred_at").isNull(), "invalid")
        .when(~F.coalesce("capture_version", F.lit(0)).between(low, high), "capture_version out of range")
    )


#: Bytes of a batch's body, and the multiple of it from which nothing of it is read.
BODY_MOST, BODY_HARD = 4 << 20, 8


def items_of(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Every item of JSON array bodies, each with its verdict; a body that is too big or no array is one rejected item."""
    text = F.col(column)
    items = F.from_json(F.when(F.octet_length(text) <= BODY_MOST * BODY_HARD, text), "array<string>")
    rows = bodies.withColumn("_items", items).withColumn("_too_big", F.octet_length(text) > BODY_MOST * BODY_HARD)
    rows = rows.select(*[c for c in bodies.columns if c != column], "_too_big", F.posexplode_outer("_items").alias("place", "item"))
    parsed = rows.withColumn("_e", F.from_json("item", EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    out = parsed.select(*[c for c in parsed.columns if c not in ("_e", "_too_big")], "_too_big", "_e.*")
    reason = F.when(F.col("_too_big"), "batch too big").when(F.col("item").isNull(), "bad payload").otherwise(verdict())
    return out.withColumn("reason", reason).drop("_too_big", "_corrupt_record")


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """One item a line, each with its verdict."""
    return spark.read.schema(EVENT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path).withColumn("reason", verdict())


def forks(heads: DataFrame) -> DataFrame:
    """Files that begin with the same record, and the one that the others were forked from (the earliest, then by name)."""
    w = Window.partitionBy("first_uuid")
    rows = heads.where("first_uuid is not null").withColumn("n", F.count("*").over(w)).where("n > 1")
    return rows.withColumn("origin", F.first("file").over(w.orderBy("first_at", "file"))).select("file", "first_uuid", "origin")


def shared_records(records: DataFrame, forks_: DataFrame) -> DataFrame:
    """Per fork the records that it has in common with the file it came from."""
    mine = forks_.where("file <> origin").join(records.select("file", "uuid").where("uuid is not null").distinct(), "file")
    theirs = records.select(F.col("file").alias("origin"), "uuid").distinct()
    return mine.join(theirs, ["origin", "uuid"], "left_semi").groupBy("file", "origin").agg(F.count("*").alias("shared"))


def vendor_sessions(dump: DataFrame) -> DataFrame:
    """Imported sessions: counts by type of message and the first prompt, from an array of messages."""
    of = lambda t: F.filter("messages", lambda m: m["type"] == t)
    return dump.select("session_id", F.size(of("user")).cast("bigint").alias("prompts"), F.size(of("assistant")).cast("bigint").alias("answers"), F.get(of("user"), F.lit(0))["message"].alias("first_prompt"))


def vendor_messages(dump: DataFrame) -> DataFrame:
    """Imported messages in order; those without an id are dropped."""
    rows = dump.select("session_id", F.posexplode("messages").alias("seq", "m"))
    return rows.where("m.event_id is not null").select("session_id", F.col("seq").cast("bigint").alias("seq"), "m.event_id", "m.type", "m.message")
