"""Which sessions, turns and milestones are due to be posted to a chat, and which already were."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A session is worth a post from so many turns or tools on.
LEAST_TURNS, LEAST_TOOLS = 2, 10


def eligible(sessions: DataFrame, preferences: DataFrame, posted: DataFrame, now, settle_minutes: int, quiet_minutes: int) -> DataFrame:
    """Sessions to post: their person wants it, they ended a while ago or went quiet, hold enough, and were not posted."""
    now = F.lit(now).cast("timestamp_ntz")
    age = F.timestamp_diff("MINUTE", F.col("ended_at"), now)
    due = F.when(F.col("head_state") == "complete", age >= settle_minutes).otherwise(age >= quiet_minutes)
    rows = sessions.where(due & ((F.col("user_turns") >= LEAST_TURNS) | (F.col("tool_calls") >= LEAST_TOOLS)))
    return rows.join(preferences.where("wanted").select("email"), "email", "left_semi").join(posted.select("session_id"), "session_id", "left_anti")


def under_daily_cap(rows: DataFrame, posted: DataFrame, now, cap: int) -> DataFrame:
    """At most `cap` posts a person in a rolling day, those already made included; the oldest sessions first."""
    since = F.lit(now).cast("timestamp_ntz") - F.expr("interval 24 hours")
    made = posted.where(F.col("posted_at") > since).groupBy("email").agg(F.count("*").alias("made"))
    w = Window.partitionBy("email").orderBy("ended_at", "session_id")
    rows = rows.join(made, "email", "left").withColumn("rn", F.row_number().over(w))
    return rows.where(F.col("rn") + F.coalesce("made", F.lit(0)) <= cap).drop("rn", "made")


def live_turns(turns: DataFrame, posted_events: DataFrame) -> DataFrame:
    """Answered turns whose last answer was not posted."""
    return turns.where("final_event_id is not null").join(posted_events.select(F.col("event_id").alias("final_event_id")), "final_event_id", "left_anti")


def url_key(url: Column) -> Column:
    """Eight bytes of a URL's digest, in hex."""
    return F.left(F.sha2(url, 256), F.lit(16))


def live_milestones(links: DataFrame, posted_keys: DataFrame) -> DataFrame:
    """Pull requests whose link was not posted, each URL once per session."""
    rows = links.where("kind = 'pr'").select("session_id", "url", url_key(F.col("url")).alias("key")).distinct()
    return rows.join(posted_keys, "key", "left_anti")


#: Fixed value: the shape of a channel's id.
CHANNEL = "^[CG][A-Z0-9]{6,20}$"


def live_eligible(sessions: DataFrame, preferences: DataFrame, attached: DataFrame, closed: DataFrame, fresh_after, limit: int = 200) -> DataFrame:
    """Fresh sessions that ask to be narrated live: their person has it on, no group narrates them, they are no continuation, shown by default and not closed."""
    asks = F.col("mirror_request").isin("on", "dm") | F.col("mirror_request").rlike(CHANNEL)
    shown = ~(F.col("session_type").isin("empty", "internal") & (F.col("head_state") != "capture_loss"))
    rows = sessions.where(asks & shown & F.col("parent_session_id").isNull() & (F.col("started_at") >= F.lit(fresh_after).cast("timestamp_ntz")))
    rows = rows.join(preferences.where("mode <> 'off'").select("email", "mode"), "email").join(attached.where("detached_at is null").select("session_id"), "session_id", "left_anti")
    return rows.join(closed.select("session_id"), "session_id", "left_anti").orderBy(F.col("started_at").desc(), "session_id").limit(limit)


def group_eligible(attached: DataFrame, sessions: DataFrame, groups: DataFrame, preferences: DataFrame, closed: DataFrame, fresh_after, limit: int = 200) -> DataFrame:
    """Active pairs of session and group: attached, the group in use, the person's live posts not off, active lately and not closed for this group."""
    rows = attached.where("detached_at is null").join(sessions.where(F.col("updated_at") >= F.lit(fresh_after).cast("timestamp_ntz")), "session_id")
    rows = rows.join(groups.where("not disabled").select("group_id", "name"), "group_id").join(preferences.where("live_disabled").select("email"), "email", "left_anti")
    return rows.join(closed.select("session_id", "group_id"), ["session_id", "group_id"], "left_anti").orderBy(F.col("updated_at").desc(), "session_id", "group_id").limit(limit)


def promoted(sessions: DataFrame, groups: DataFrame, fresh_after) -> DataFrame:
    """Fresh sessions that ask for a group by name, each with one group: the person's own before one of everybody's."""
    named = ~F.col("mirror_request").isin("", "on", "dm") & ~F.col("mirror_request").rlike(CHANNEL)
    rows = sessions.where(named & F.col("parent_session_id").isNull() & (F.col("started_at") >= F.lit(fresh_after).cast("timestamp_ntz")))
    open_ = groups.where("not disabled").select("group_id", F.col("name").alias("mirror_request"), "owner_email", "visibility")
    found = rows.join(open_, "mirror_request").where((F.col("owner_email") == F.col("email")) | (F.col("visibility") == "org"))
    w = Window.partitionBy("session_id").orderBy((F.col("owner_email") != F.col("email")), "group_id")
    return found.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("session_id", "group_id", "email")
