"""What is derived from events: message rows, opening prompts, session classes, rollups from turns, retention previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.keys import kind_of
from .merge import empty_kind, merged_type

#: Types of events that count as content, and how an unattended run is told.
CONTENT = ("user_prompt", "assistant_turn", "tool_call", "tool_result", "tool_failed", "file_changed", "compaction", "artifact")
UNATTENDED_ENTRY, UNATTENDED_ORIGINATOR = "sdk-cli", "codex_exec"


def is_content() -> Column:
    return F.col("type").isin(*CONTENT)


def automation(entrypoint: Column, raw: Column) -> Column:
    """Evidence that nobody sat at the session: its entrypoint, or the originator that its first record names."""
    return F.coalesce(entrypoint == UNATTENDED_ENTRY, F.lit(False)) | F.coalesce(F.get_json_object(raw, "$.payload.originator").startswith(UNATTENDED_ORIGINATOR), F.lit(False))


def internal_prompt(text: Column, templates: tuple[str, ...]) -> Column:
    """The opening is one of the templates by which helpers of the harness speak to it."""
    opening = F.regexp_replace(text, r"^\s+", "")
    out = F.lit(False)
    for t in templates:
        out = out | opening.startswith(t)
    return out


def messages(events: DataFrame) -> DataFrame:
    """Message rows of text-bearing events: role by type, kind by the classifier."""
    role = F.when(F.col("type") == "user_prompt", "user").when(F.col("type") == "assistant_turn", "assistant").otherwise("tool")
    return events.withColumn("kind", kind_of(events)).where("kind is not null and text is not null").select("id", "session_id", "seq", role.alias("role"), "kind", "text")


def reclassified(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """Rows of a new derivation that differ from the stored ones, or are not stored."""
    old = stored.select("id", F.col("kind").alias("_kind"), F.col("role").alias("_role"), F.col("text").alias("_text"), F.lit(True).alias("_here"))
    same = F.col("kind").eqNullSafe(F.col("_kind")) & F.col("role").eqNullSafe(F.col("_role")) & F.col("text").eqNullSafe(F.col("_text"))
    return derived.join(old, "id", "left").where(F.col("_here").isNull() | ~same).select(*derived.columns)


def opening(messages_: DataFrame) -> DataFrame:
    """Per session the first thing a person said, or else the first message of any kind, as its title and prompt."""
    human = F.col("kind").isin("human", "slash_command")
    order = F.struct("seq", "id")
    rows = messages_.where("role = 'user'").groupBy("session_id").agg(F.min_by(F.when(human, F.col("text")), F.when(human, order)).alias("said"), F.min_by("text", order).alias("any"))
    return rows.select("session_id", F.coalesce("said", "any").alias("first_prompt"), T.title(F.coalesce("said", "any")).alias("title"))


def classified(events: DataFrame, drops: DataFrame, templates: tuple[str, ...]) -> DataFrame:
    """Per session its type (automation over internal over empty over user), the kind of an empty one, and the state of its head.

    events: session_id, id, seq, type, occurred_at, text, entrypoint, raw; drops: session_id.
    """
    content = F.sum(is_content().cast("bigint"))
    first = F.min_by(F.when(F.col("type") == "user_prompt", F.col("text")), F.when(F.col("type") == "user_prompt", F.struct("seq", "id")))
    rows = events.groupBy("session_id").agg(
        content.alias("content"), first.alias("opening"), F.bool_or(automation(F.col("entrypoint"), F.col("raw"))).alias("auto"), F.bool_or(F.col("type") == "session_ended").alias("ended"),
        F.max(F.when(F.col("type") == "session_ended", F.col("text"))).alias("reason"), F.min("occurred_at").alias("a"), F.max("occurred_at").alias("b"),
    )
    kind = F.when(F.col("auto"), "automation").when(internal_prompt(F.coalesce("opening", F.lit("")), templates), "internal").when(F.col("content") == 0, "empty").otherwise("user")
    rows = rows.withColumn("session_type", kind).join(drops.select("session_id").distinct().withColumn("lost", F.lit(True)), "session_id", "left")
    state = F.when(F.col("lost"), "capture_loss").when(F.col("content") > 0, "complete").otherwise("unknown")
    seconds = F.timestamp_diff("SECOND", F.col("a"), F.col("b"))
    return rows.select("session_id", "session_type", F.when(F.col("session_type") == "empty", empty_kind(F.col("ended"), F.coalesce("reason", F.lit("")), seconds)).alias("empty_kind"), state.alias("head_state"), F.col("content").alias("content_events"))


def promoted(sessions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Sessions with the types that a batch's evidence gives them merged in."""
    both = sessions.select("session_id", "session_type").unionByName(evidence.where("auto").select("session_id", F.lit("automation").alias("session_type")))
    known = sessions.select("session_id")
    return both.join(known, "session_id", "left_semi").groupBy("session_id").agg(merged_type(F.col("session_type")).alias("session_type"))


def rollup_of_turns(turns: DataFrame, events: DataFrame) -> DataFrame:
    """Per session the sums of its main turns, how many of them were answered, and its content events."""
    main = F.col("thread") == ""
    n = lambda c: F.sum(F.when(main, F.col(c)).otherwise(0)).cast("bigint").alias(c)
    rows = turns.groupBy("session_id").agg(F.count_if(main).alias("turns"), F.count_if(main & (F.col("outcome") == "answered")).alias("answered"), n("prompts"), n("tools"), n("errors"), n("active_ms"), n("subagents"))
    return rows.join(events.where(is_content()).groupBy("session_id").agg(F.count("*").alias("content_events")), "session_id", "left").withColumn("content_events", F.coalesce("content_events", F.lit(0)))


def inherited(turns: DataFrame, lineage: DataFrame, records: DataFrame) -> DataFrame:
    """Turns whose opening record the parent session already has."""
    rows = turns.join(lineage, turns["session_id"] == lineage["child_session"]).drop("child_session")
    return rows.join(records.select(F.col("session_id").alias("parent_session"), "record_uuid"), ["parent_session", "record_uuid"], "left_semi")


def due(events: DataFrame, before, cap: int = 100_000) -> DataFrame:
    """How many bodies retention would replace, counted up to a cap, and whether the cap was reached."""
    rows = events.where((F.col("occurred_at") < F.lit(before).cast("timestamp_ntz")) & ~F.col("expired")).select("id").limit(cap)
    return rows.agg(F.count("*").alias("due")).withColumn("capped", F.col("due") >= cap)


def swept(reports: DataFrame, hours: DataFrame, before) -> DataFrame:
    """Raw reports that stay: from the horizon on, or of hours that were not rolled up yet."""
    at = F.lit(before).cast("timestamp_ntz")
    done = hours.select(F.col("email").alias("_e"), F.col("device_id").alias("_d"), F.col("hour").alias("_h")).distinct()
    on = (F.col("email") == F.col("_e")) & F.col("device_id").eqNullSafe(F.col("_d")) & (F.date_trunc("hour", F.col("emitted_at")) == F.col("_h"))
    return reports.where(F.col("emitted_at") >= at).unionByName(reports.where(F.col("emitted_at") < at).join(done, on, "left_anti"))


def report_upsert(reports: DataFrame) -> DataFrame:
    """Reports, each (person, device, time) once, the first to arrive."""
    w = Window.partitionBy("email", "device_id", "emitted_at").orderBy("id")
    return reports.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def projection(events: DataFrame, messages_: DataFrame, ledger: DataFrame) -> DataFrame:
    """What the turn fold reads of each event: its keys, its text's kind and hash, and whether it was priced."""
    m = messages_.select("id", "kind", T.text_hash(F.col("text")).alias("text_hash"), (T.trimmed(F.col("text")) != "").alias("has_text"))
    rows = events.join(m, "id", "left").join(ledger.select(F.col("event_id").alias("id")).distinct().withColumn("priced", F.lit(True)), "id", "left")
    return rows.withColumn("has_text", F.coalesce("has_text", F.lit(False))).withColumn("has_usage", F.coalesce("priced", F.lit(False)) | (F.coalesce("message_id", F.lit("")) != "")).drop("priced")
