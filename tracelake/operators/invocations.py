"""Skill invocations: derived from events, assembled from the API, settled against stored rows, and pages over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.keys import builtin_command
from .pairing import nearest
from .skills import FEWEST

#: How far an API row's time may be from now, and how old a mirror may be.
AHEAD_MINUTES, BEHIND_DAYS, MIRROR_DAYS = 5, 30, 14


def derived(events: DataFrame) -> DataFrame:
    """Invocations that events show: calls of the skill tool, typed commands, and mentions.

    events: id, session_id, seq, type, origin, occurred_at, prompt_id, tool_use_id, tool_name, tool_input, text.
    """
    typed = T.command(F.col("text"))
    mention = F.regexp_extract("text", r"(?:^|\s)\$([A-Za-z0-9][A-Za-z0-9_-]*)", 1)
    bare = F.regexp_replace(typed, "^/", "")
    raw = (
        F.when((F.col("type") == "tool_call") & (F.col("tool_name") == "Skill"), F.get_json_object("tool_input", "$.skill"))
        .when((F.col("type") == "user_prompt") & (bare != "") & ~(builtin_command(bare) & ~bare.contains(":")), bare)
        .when((F.col("type") == "user_prompt") & (typed == "") & (mention != ""), mention)
    )
    plugin, skill = T.skill_name(F.col("raw_name"))
    rows = events.withColumn("raw_name", raw).withColumn("plugin", plugin).withColumn("skill", skill).where("skill is not null")
    trigger = F.when(F.col("type") == "tool_call", "model").otherwise("user")
    none = F.lit(None).cast("string")
    key = T.dedupe_key(F.when(F.col("type") == "tool_call", F.col("tool_use_id")), none, F.when(F.col("type") == "user_prompt", F.col("session_id")), F.col("prompt_id"), F.col("skill"), F.col("id"))
    return rows.select("id", "session_id", "occurred_at", "plugin", "skill", trigger.alias("trigger"), key.alias("dedupe_key"), F.lit("derived").alias("origin"))


def best_candidates(rows: DataFrame) -> DataFrame:
    """Of the rows of one key the one with a composite name, then the one from an envelope, then the earliest."""
    w = Window.partitionBy("dedupe_key").orderBy(F.col("plugin").isNotNull().desc(), F.col("envelope").desc(), "occurred_at", "id")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def assembled(rows: DataFrame, tokens: DataFrame, now) -> DataFrame:
    """API rows as invocations: the emitter's trust, the time clamped to the window around now, and why a row is refused."""
    at = F.lit(now).cast("timestamp_ntz")
    late, early = at + F.expr(f"interval {AHEAD_MINUTES} minutes"), at - F.expr(f"interval {BEHIND_DAYS} days")
    rows = rows.join(tokens.select("token_id", F.col("platform").alias("t_platform"), "active"), "token_id", "left")
    reason = (
        F.when(~F.coalesce("active", F.lit(False)), "token")
        .when(F.coalesce("skill", F.lit("")) == "", "missing skill")
        .when(F.col("platform") != F.col("t_platform"), "platform")
        .when(F.col("occurred_at") < early, "too old")
    )
    clamped = F.coalesce(F.col("occurred_at") > late, F.lit(False))
    return rows.select("id", "platform", "skill", F.when(clamped, at).otherwise(F.col("occurred_at")).alias("occurred_at"), clamped.alias("time_clamped"), F.lit("source").alias("trust"), F.lit("api").alias("origin"), reason.alias("reason"))


def stored_twins(orphans: DataFrame, prompts: DataFrame, within: int = 120) -> DataFrame:
    """Command rows without a prompt id paired with the hook prompts of the same session and command, each once, the nearest first."""
    return nearest(orphans, prompts, within)


def unsettled(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows that would change a stored one, or are not stored: the others need no write."""
    columns = ["origin", "outcome", "plugin", "skill", "link_ref", "session_type"]
    old = stored.select("dedupe_key", *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_here"))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(old, "dedupe_key", "left").where(F.col("_here").isNull() | ~same).select(*rows.columns)


def unknown_folded(cells: DataFrame, admin: bool) -> DataFrame:
    """Unknown names for a member: those of fewer than three people are one row without a name."""
    if admin:
        return cells
    small = F.col("people") < FEWEST
    rows = cells.withColumns({"plugin": F.when(~small, F.col("plugin")), "skill": F.when(~small, F.col("skill"))})
    return rows.groupBy("plugin", "skill").agg(F.sum("invocations").cast("bigint").alias("invocations"), F.sum("people").cast("bigint").alias("people"))


def exact_compliance(rows: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Per day and lineage: beacon rows, and those whose session a reconciler row names."""
    linked = reconciled.select(F.col("link_ref").alias("session_ref")).distinct().withColumn("linked", F.lit(True))
    cells = rows.where("origin = 'api'").join(linked, "session_ref", "left")
    return cells.groupBy(F.to_date("occurred_at").alias("day"), "plugin").agg(F.count("*").alias("beacon"), F.count_if("linked").alias("exact"))


def buckets_with_people(rows: DataFrame, unit: str) -> DataFrame:
    """Per bucket and platform its rows, with the people of the whole platform beside them."""
    cells = rows.groupBy("platform").agg(F.countDistinct("actor_email").alias("people"))
    return rows.groupBy(F.date_trunc(unit, "occurred_at").cast("date").alias("bucket"), "platform").agg(F.count("*").alias("invocations")).join(cells, "platform")


def lineage_parts(lineage: Column) -> tuple[Column, Column, Column]:
    """(repository, plugin, skill) of repo/plugin:skill; a name without a plugin has none."""
    repo, rest = F.substring_index(lineage, "/", 1), F.regexp_replace(lineage, "^[^/]*/", "")
    return repo, F.when(rest.contains(":"), F.substring_index(rest, ":", 1)), F.when(rest.contains(":"), F.regexp_replace(rest, "^[^:]*:", "")).otherwise(rest)


def whole_days(since: Column, now: Column) -> Column:
    return F.greatest(F.lit(0), F.floor(F.timestamp_diff("SECOND", since, now) / 86_400)).cast("bigint")


def stale_mirrors(entries: DataFrame, heads: DataFrame, publishes: DataFrame, now) -> DataFrame:
    """Catalog copies whose digest is not their head's, or whose repository was published too long ago."""
    last = publishes.groupBy("source_repo").agg(F.max("generated_at").alias("last"))
    rows = entries.join(heads.select("skill", F.col("digest").alias("head_digest")), "skill").join(last, "source_repo", "left")
    behind = F.timestamp_diff("SECOND", F.col("last"), F.lit(now).cast("timestamp_ntz")) > MIRROR_DAYS * 86_400
    return rows.where((F.col("digest") != F.col("head_digest")) | F.coalesce(behind, F.lit(True))).select("entry_id", (F.col("digest") != F.col("head_digest")).alias("differs"))


def token_summary(tokens: DataFrame, rows: DataFrame, now) -> DataFrame:
    """Per token: its last row, the rows of the last day, minutes since the last, and whole days until it expires."""
    at = F.lit(now).cast("timestamp_ntz")
    seen = rows.groupBy("token_id").agg(F.max("occurred_at").alias("last_at"), F.count_if(F.col("occurred_at") >= at - F.expr("interval 24 hours")).alias("day_rows"))
    out = tokens.join(seen, "token_id", "left")
    return out.select("token_id", "last_at", F.coalesce("day_rows", F.lit(0)).alias("day_rows"), F.timestamp_diff("MINUTE", F.col("last_at"), at).cast("bigint").alias("idle_minutes"), whole_days(at, F.col("expires_at")).alias("days_left"))


def session_strip(rows: DataFrame, session, catalog: DataFrame) -> DataFrame:
    """Derived rows of one session with the repository of the catalog's copy."""
    mine = rows.where((F.col("session_ref") == session) & (F.col("origin") == "derived"))
    copy = catalog.groupBy("plugin", "skill").agg(F.min("source_repo").alias("source_repo"))
    return mine.join(copy, ["plugin", "skill"], "left").select("id", "plugin", "skill", "source_repo", "occurred_at")
