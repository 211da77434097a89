"""Reads of one session and pages over events, turns, links, artifacts and the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reads import page_size

#: Fixed value: kinds of links in display order.
LINK_RANK = ("pr", "issue", "commit", "repo", "doc", "slack", "other")
OUTPUT_SHOWN = 4000


def after(columns: list[Column], values: list, descending: bool = False) -> Column:
    """Keyset predicate: the row comes after the given position in the order of the columns."""
    out = F.lit(False)
    for c, v in reversed(list(zip(columns, values, strict=True))):
        out = (c < v if descending else c > v) | ((c == v) & out)
    return out


def thread_order() -> list[Column]:
    return [F.col("occurred_at"), F.coalesce("agent_id", F.lit("")), F.col("seq")]


def timeline(events: DataFrame, session: str, position: tuple | None = None, limit: int | None = None) -> DataFrame:
    """Events of a session in the order of (time, thread, seq), copies that another event stands for left out; a row more than the page."""
    rows = events.where((F.col("session_id") == session) & F.col("superseded_by").isNull())
    if position:
        rows = rows.where(after(thread_order(), [F.lit(position[0]).cast(events.schema["occurred_at"].dataType), F.lit(position[1]), F.lit(position[2])]))
    return rows.orderBy(*thread_order()).limit(page_size(limit) + 1)


def events_after(events: DataFrame, session: str, seq: int, limit: int | None = None) -> DataFrame:
    return events.where((F.col("session_id") == session) & (F.col("seq") > seq)).orderBy("seq", "id").limit(page_size(limit))


def shown(output: Column, most: int = OUTPUT_SHOWN) -> Column:
    return F.left(output, F.lit(most))


def without_member(body: Column, member: str) -> Column:
    """A JSON object without one of its members; other values stay as they are."""
    kinds = F.from_json(body, "map<string,string>")
    kept = F.map_filter(kinds, lambda k, _: k != member)
    return F.to_json(kept)


def turn_page(turns: DataFrame, session: str, first: int, limit: int) -> DataFrame:
    """A page of main turns, and the turns of subagents that started inside the time that the page spans."""
    mine = turns.where(F.col("session_id") == session)
    page = mine.where((F.col("thread") == "") & (F.col("turn_index") >= first)).orderBy("turn_index").limit(limit)
    span = page.agg(F.min("started_at").alias("_from"), F.max("last_activity_at").alias("_to"))
    inside = mine.where("thread <> ''").join(F.broadcast(span), F.col("started_at").between(F.col("_from"), F.col("_to")), "left_semi")  # one row
    return page.unionByName(inside)


def rows_of(events: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """Events of a list of keys; the keys are a page's."""
    return events.join(F.broadcast(wanted.select(*on).distinct()), on, "left_semi")


def keyset_page(rows: DataFrame, at: str, key: str, position: tuple | None, limit: int | None = None) -> DataFrame:
    """Newest first by (at, key), after a position; one more row than the page."""
    if position:
        rows = rows.where(after([F.col(at), F.col(key)], [F.lit(position[0]).cast(rows.schema[at].dataType), F.lit(position[1])], descending=True))
    return rows.orderBy(F.col(at).desc(), F.col(key).desc()).limit(page_size(limit) + 1)


def links_ranked(links: DataFrame) -> DataFrame:
    """Links with their rank by kind, in display order."""
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(LINK_RANK)], F.lit(len(LINK_RANK)))
    return links.withColumn("rank", rank).orderBy("rank", "first_at", "url")


def links_of(events: DataFrame) -> DataFrame:
    """Per session and URL: first and last time, and how often; events has an array of urls."""
    rows = events.select("session_id", "occurred_at", F.explode("urls").alias("url"))
    return rows.groupBy("session_id", "url").agg(F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"), F.count("*").alias("occurrences"))


def path_history(artifacts: DataFrame, readable: DataFrame, path: Column, limit: int = 50) -> DataFrame:
    """Artifacts of a path over the sessions that may be read, the last changed first."""
    return artifacts.where(path).join(readable.select("session_id"), "session_id", "left_semi").orderBy(F.col("last_at").desc(), "session_id").limit(limit)


def snapshots(events: DataFrame) -> DataFrame:
    """Changes that can become an artifact: a path, and a content on either side; the content is the one before if there is any, else the one after."""
    content = F.coalesce(F.when(F.col("before") != "", F.col("before")), F.when(F.col("after") != "", F.col("after")))
    return events.where((F.col("type") == "file_changed") & (F.coalesce("path", F.lit("")) != "")).withColumn("content", content).where("content is not null")


def artifact_with_versions(artifacts: DataFrame, versions: DataFrame) -> DataFrame:
    """An artifact's versions, the newest first, beside it."""
    w = Window.partitionBy("session_id", "path").orderBy(F.col("occurred_at").desc(), F.col("id").desc())
    return artifacts.join(versions.withColumn("place", F.row_number().over(w)), ["session_id", "path"])


def dirty(sessions: DataFrame, parked: DataFrame, limit: int = 200) -> DataFrame:
    """The sessions that were touched since they were folded, the longest waiting first, without those that are parked."""
    stale = F.col("folded_at").isNull() | (F.col("updated_at") > F.col("folded_at"))
    return sessions.where(stale).join(parked.select("session_id"), "session_id", "left_anti").orderBy("updated_at", "session_id").limit(limit)


def parked_until(failures: Column, last: Column, seconds: int = 30, most: int = 3600) -> Column:
    """When a session that failed is tried again: the wait doubles with each failure, up to an hour."""
    wait = F.least(F.lit(most), F.lit(seconds) * F.pow(F.lit(2.0), F.least(failures - 1, F.lit(20)))).cast("int")
    return F.when(failures > 0, F.timestamp_add("SECOND", wait, last))


def repairs(sessions: DataFrame, turns: DataFrame, spent: DataFrame, limit: int = 50) -> DataFrame:
    """Sessions to walk again, the newest first: with a turn that has no answer, or of a tool that counts tokens and without any."""
    open_ = sessions.join(turns.where("outcome = 'no_answer_captured'").select("session_id"), "session_id", "left_semi").withColumn("reason", F.lit("missing_answer"))
    free = sessions.where("source = 'second'").join(spent.select("session_id"), "session_id", "left_anti").withColumn("reason", F.lit("missing_tokens"))
    rows = open_.unionByName(free).groupBy("session_id", "started_at").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    return rows.orderBy(F.col("started_at").desc(), "session_id").limit(limit)


def read_one(readable: DataFrame, session: str, viewer: str, at) -> tuple[DataFrame, DataFrame]:
    """A session if the viewer may read it, and the row that the audit log gets for it; a missing one and a forbidden one are the same: nothing."""
    row = readable.where(F.col("session_id") == session)
    return row, accesses(row, viewer, at)


def accesses(rows: DataFrame, viewer: str, at) -> DataFrame:
    """One audit row for each session of somebody else among the rows."""
    return rows.where(F.col("email") != viewer).select("session_id").distinct().select(F.lit(viewer).alias("viewer"), "session_id", F.lit(at).cast("timestamp_ntz").alias("at"))


def live_share(shares: DataFrame, token: str, viewer: str, now) -> DataFrame:
    """The share that a token stands for, while it is neither revoked nor expired and meant for this viewer."""
    alive = ~F.col("revoked") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp_ntz")))
    return shares.where((F.col("token") == token) & alive & (F.col("grantee").isNull() | (F.col("grantee") == viewer)))


def shares_of(shares: DataFrame, viewer: str, admin: bool) -> DataFrame:
    """Shares that a person may see and revoke: their own, for an admin all."""
    return shares if admin else shares.where(F.col("owner_email") == viewer)


def facets(sessions: DataFrame, drops: DataFrame, answers: DataFrame) -> DataFrame:
    """Per session of a page: drops around it where its capture was lost, and the first 400 characters of its first answer."""
    first = answers.groupBy("session_id").agg(F.left(F.min_by("text", "seq"), F.lit(400)).alias("first_answer"))
    rows = sessions.join(drops, "session_id", "left").join(first, "session_id", "left")
    return rows.select("session_id", F.when(F.col("head_state") == "capture_loss", F.coalesce("drops", F.lit(0))).alias("drops"), "first_answer")


def turn_view(turns: DataFrame, events: DataFrame) -> DataFrame:
    """Per main turn its work in order as one text (type and number of each run of equal types), and how many subagent turns it has."""
    order = Window.partitionBy("session_id", "turn_index").orderBy("occurred_at", "seq")
    rows = events.withColumn("new", (F.coalesce(F.lag("type").over(order) != F.col("type"), F.lit(True))).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(order))
    runs = rows.groupBy("session_id", "turn_index", "run", "type").agg(F.count("*").alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "type", "n"))), lambda r: F.concat(r["type"], F.lit("x"), r["n"].cast("string"))), " ")
    return turns.join(runs.groupBy("session_id", "turn_index").agg(text.alias("work")), ["session_id", "turn_index"], "left")


def stacked_peak(rows: DataFrame, bucket: str, value: str) -> DataFrame:
    """The highest sum over the series of one bucket."""
    return rows.groupBy(bucket).agg(F.sum(value).alias("s")).agg(F.max("s").cast("bigint").alias("peak"))


def enrolled(devices: DataFrame) -> DataFrame:
    """The device that holds each (person, host): the last enrolled supersedes those before it."""
    w = Window.partitionBy("email", "hostname").orderBy(F.col("device_id").desc())
    return devices.withColumn("rn", F.row_number().over(w)).withColumn("superseded", F.col("rn") > 1).drop("rn")
