"""Fleet health: counter deltas, hourly rollups, verdicts and alert rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reasons that are no loss, and ranks of levels.
NOT_LOSS = ("recovered_from_transcript", "parked", "tmp_swept")
LEVELS = {"critical": 3, "degraded": 2}
#: Aborted starts and their share from which a device is at fault; the share of answers that may be missing; the length of a full commit id.
EMPTY_LEAST, EMPTY_SHARE, MISSING_SHARE = 20, 0.5, 0.10


def is_loss(reason: Column) -> Column:
    return ~reason.isin(*NOT_LOSS)


def rank(level: Column) -> Column:
    return F.when(level == "critical", 3).when(level == "degraded", 2).otherwise(1)


def counter_deltas(reports: DataFrame) -> DataFrame:
    """Growth of each device's counter per reason.

    A first value counts whole unless it is in the device's very first report
    (0); a counter below its last value was reset and counts whole.
    """
    device = Window.partitionBy("email", "device_id").orderBy("emitted_at", "id")
    series = Window.partitionBy("email", "device_id", "reason").orderBy("emitted_at", "id")
    rows = reports.withColumn("device_first", F.lag("id").over(device).isNull()).withColumn("before", F.lag("total").over(series))
    delta = F.when(F.col("before").isNull(), F.when(F.col("device_first"), 0).otherwise(F.col("total"))).when(F.col("total") < F.col("before"), F.col("total")).otherwise(F.col("total") - F.col("before"))
    return rows.withColumn("delta", delta.cast("bigint")).drop("before", "device_first")


def seeded(reports: DataFrame, since, until) -> DataFrame:
    """Deltas of a window of time: its reports, and of each device and reason the newest report before it as the baseline."""
    a, b = (F.lit(x).cast("timestamp_ntz") for x in (since, until))
    inside = reports.where((F.col("emitted_at") >= a) & (F.col("emitted_at") < b)).withColumn("_in", F.lit(True))
    w = Window.partitionBy("email", "device_id", "reason").orderBy(F.col("emitted_at").desc(), F.col("id").desc())
    before = reports.where(F.col("emitted_at") < a).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn").withColumn("_in", F.lit(False))
    return counter_deltas(before.unionByName(inside)).where("_in").drop("_in")


def hourly(reports: DataFrame, seconds: int = 300) -> DataFrame:
    """Per device and hour: reports, worst level, loss, maxima, blocked seconds (at most an hour) and the last total."""
    rows = counter_deltas(reports).withColumn("hour", F.date_trunc("hour", "emitted_at"))
    worst = F.max(rank(F.col("worst")))
    return rows.groupBy("email", "device_id", "hour").agg(
        F.count("*").alias("reports"),
        worst.cast("bigint").alias("worst_rank"),
        F.sum(F.when(is_loss(F.col("reason")), F.col("delta")).otherwise(0)).cast("bigint").alias("drops"),
        F.max("quarantine").alias("quarantine"),
        F.least(F.lit(3600), F.sum(F.when(F.col("worst") == "critical", seconds).otherwise(0))).cast("bigint").alias("blocked_seconds"),
        F.max_by("total", F.struct("emitted_at", "id")).alias("last_total"),
        F.max("emitted_at").alias("last_at"),
    )


def kinds(reports: DataFrame) -> DataFrame:
    return reports.groupBy(F.date_trunc("hour", "emitted_at").alias("hour"), F.concat_ws("/", "reason", "worst").alias("kind")).agg(F.count("*").alias("n"))


def latest_reports(reports: DataFrame) -> DataFrame:
    """The newest report of each device; a null device is a device."""
    w = Window.partitionBy("email", "device_id").orderBy(F.col("emitted_at").desc(), F.col("id").desc())
    return reports.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def recent_builds(reports: DataFrame) -> DataFrame:
    return reports.where("build <> ''").groupBy("build").agg(F.max("emitted_at").alias("last_seen"), F.min("emitted_at").alias("first_seen"), F.countDistinct("email").alias("people"))


def empty_starts(sessions: DataFrame, least: int = EMPTY_LEAST, share: float = EMPTY_SHARE) -> DataFrame:
    """Per device: sessions, those that were aborted without content, the first five folders of these, and whether that is too many."""
    empty = (F.col("session_type") == "empty") & F.coalesce(F.col("empty_kind") == "aborted", F.lit(False))
    rows = sessions.groupBy("email", "device_id").agg(
        F.count("*").alias("sessions"),
        F.sum(empty.cast("bigint")).alias("empty"),
        F.array_join(F.slice(F.array_sort(F.collect_set(F.when(empty & (F.col("cwd") != ""), F.col("cwd")))), 1, 5), ",").alias("cwds"),
    )
    return rows.withColumn("alert", (F.col("empty") >= least) & (F.col("empty") >= share * F.col("sessions")))


def missing_answers(events: DataFrame) -> DataFrame:
    """Per day and origin: sessions with a prompt, and those of them without any answer."""
    s = Window.partitionBy("session_id")
    rows = events.withColumn("prompts", F.sum(F.when(F.col("type") == "user_prompt", 1).otherwise(0)).over(s)).withColumn("answers", F.sum(F.when(F.col("type") == "assistant_turn", 1).otherwise(0)).over(s))
    rows = rows.where("prompts > 0")
    return rows.groupBy(F.to_date("occurred_at").alias("day"), "origin").agg(F.countDistinct("session_id").alias("sessions"), F.countDistinct(F.when(F.col("answers") == 0, F.col("session_id"))).alias("missing"))


def silence(devices: DataFrame, reports: DataFrame, now, hours: int = 24) -> DataFrame:
    """Per person, of devices and reports together: the last report and whether it is too long ago (never: silent)."""
    seen = reports.groupBy("email").agg(F.max("emitted_at").alias("last_at"))
    people = devices.where(~F.col("revoked")).select("email").distinct()
    now = F.lit(now).cast("timestamp_ntz")
    rows = people.withColumn("enrolled", F.lit(True)).join(seen, "email", "full")
    return rows.select("email", F.coalesce("enrolled", F.lit(False)).alias("enrolled"), "last_at", (F.col("last_at").isNull() | (F.timestamp_diff("SECOND", F.col("last_at"), now) > hours * 3600)).alias("silent"))


def version_state(build: Column, wanted: str) -> Column:
    return F.when(build.isNull() | (build == ""), "unknown").when(build == wanted, "current").when(build.rlike("^[0-9]+[.][0-9]+$"), "lagging").otherwise("unmanaged")


def is_commit(build: Column) -> Column:
    return build.rlike("^[0-9a-f]{7,40}$")


def same_commit(a: Column, b: Column) -> Column:
    """One of two commit ids is a prefix of the other."""
    return is_commit(a) & is_commit(b) & (a.startswith(b) | b.startswith(a))


def commit_state(build: Column, wanted: Column) -> Column:
    """A build judged against the published commit: unknown without either, unmanaged if it is no commit id."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.when(blank(build), "unknown").when(~is_commit(build), "unmanaged").when(blank(wanted), "unknown").when(same_commit(build, wanted), "current").otherwise("lagging")


def build_verdicts(reports: DataFrame, wanted: str, now, minutes: int = 60) -> DataFrame:
    """Per device: current if any report of the last hour had the published build, and which other build it ran beside it; else its newest report's build is judged."""
    at = F.lit(now).cast("timestamp_ntz")
    recent = (F.col("emitted_at") > at - F.expr(f"interval {minutes} minutes")) & (F.col("emitted_at") <= at)
    good = same_commit(F.col("build"), F.lit(wanted))
    order = F.struct("emitted_at", "id")
    rows = reports.where((F.col("build") != "") & (F.col("emitted_at") <= at)).groupBy("email", "device_id").agg(
        F.max_by("build", order).alias("newest"),
        F.max_by(F.when(recent & good, F.col("build")), F.when(recent & good, order)).alias("published"),
        F.max_by(F.when(recent & ~good, F.col("build")), F.when(recent & ~good, order)).alias("other"),
    )
    hit = F.col("published").isNotNull()
    return rows.select("email", "device_id", F.coalesce("published", "newest").alias("build"), F.when(hit, "current").otherwise(commit_state(F.col("newest"), F.lit(wanted))).alias("state"), F.when(hit, F.col("other")).alias("also"))


def missing_rate(cohorts: DataFrame, over: float = MISSING_SHARE) -> DataFrame:
    """Over all cohorts of the latest day that has turns: turns, answered, the rate without an answer, and whether it is too high."""
    some = cohorts.where("turns > 0")
    day = some.agg(F.max("day").alias("last"))
    rows = some.join(F.broadcast(day), F.col("day") == F.col("last"))  # one row
    out = rows.groupBy("day").agg(F.sum("turns").cast("bigint").alias("turns"), F.sum("answered").cast("bigint").alias("answered"))
    rate = 1 - F.col("answered") / F.col("turns")
    return out.withColumn("rate", F.round(rate, 6)).withColumn("alert", rate > over)


def silence_minutes(last: Column, now: Column, first_expected: Column, counted: Column) -> Column:
    """Counted minutes since the last row; a series that never had one is silent for ever (100000) once a day of grace is over."""
    never = F.when(F.timestamp_diff("HOUR", first_expected, now) < 24, F.lit(0)).otherwise(F.lit(100_000))
    return F.when(last.isNull(), never).otherwise(counted)


def decoded(report: Column, schema: str = "schema_version int, spool struct<pending: long, parked: long, dropped: map<string,long>>, empty_starts long, host string, device string") -> Column:
    """A report's values; parked and empty_starts were not sent before version 2: null there, 0 from then on if left out."""
    r = F.from_json(report, schema)
    later = lambda c: F.when(r["schema_version"] >= 2, F.coalesce(c, F.lit(0)))
    return F.struct(r["schema_version"].alias("schema_version"), r["spool"]["pending"].alias("pending"), later(r["spool"]["parked"]).alias("parked"), later(r["empty_starts"]).alias("empty_starts"), r["spool"]["dropped"].alias("dropped"), r["host"].alias("host"))


def redacted(host: Column, tokens: Column, text: Column) -> tuple[Column, Column]:
    """The host's digest, and a text in which none of the identifying tokens is left."""
    return F.left(F.sha2(host, 256), F.lit(12)), F.aggregate(F.filter(tokens, lambda t: F.length(t) > 2), text, lambda out, t: F.replace(out, t, F.lit("<redacted>")))


def hours_since(hours: DataFrame, since) -> DataFrame:
    """Drops by device and reason of the hours since then; reasons is a map of counts."""
    rows = hours.where(F.col("hour") >= F.lit(since).cast("timestamp_ntz")).select("email", "device_id", F.explode("reasons").alias("reason", "n"))
    return rows.groupBy("email", "device_id", "reason").agg(F.sum("n").cast("bigint").alias("drops"))


def loss_windows(sessions: DataFrame, drops: DataFrame, minutes: int = 5) -> DataFrame:
    """Sessions with a drop hour of their device around them.

    Each session names the hours it touches (five minutes more on both sides),
    which makes the interval join an equi join; null devices match null.
    """
    around = F.expr(f"interval {minutes} minutes")
    hours = F.sequence(F.date_trunc("hour", F.col("started_at") - around).cast("timestamp_ntz"), F.date_trunc("hour", F.col("ended_at") + around).cast("timestamp_ntz"), F.expr("interval 1 hour"))
    touched = sessions.select("session_id", "email", "device_id", F.explode(hours).alias("hour"))
    hit = drops.where("drops > 0").select(F.col("email").alias("d_email"), F.col("device_id").alias("d_device"), F.col("hour").cast("timestamp_ntz").alias("d_hour"), "drops")
    on = (F.col("email") == F.col("d_email")) & F.col("device_id").eqNullSafe(F.col("d_device")) & (F.col("hour") == F.col("d_hour"))
    return touched.join(hit, on).groupBy("session_id").agg(F.sum("drops").cast("bigint").alias("drops"))


def ratio_alert(rows: DataFrame, over: float, length: int) -> DataFrame:
    """Hours whose share of errors is over the threshold, in runs of at least `length` windows in a row."""
    w = rows.groupBy(F.window("occurred_at", "1 hour").getField("start").alias("at")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("type") == "tool_failed", 1).otherwise(0)).cast("bigint").alias("bad"))
    hot = w.where(F.col("bad") > over * F.col("n"))
    order = Window.orderBy("at")  # one row a window of time, summed up before
    island = hot.withColumn("island", F.floor(F.unix_timestamp(F.col("at").cast("timestamp")) / 3600) - F.row_number().over(order))
    return island.groupBy("island").agg(F.min("at").alias("since"), F.count("*").alias("windows"), F.sum("bad").cast("bigint").alias("bad")).where(F.col("windows") >= length).drop("island")


def absence(reports: DataFrame, hours: int) -> DataFrame:
    """Gaps of at least so many hours between a person's reports."""
    w = Window.partitionBy("email").orderBy("emitted_at", "id")
    rows = reports.withColumn("next_at", F.lead("emitted_at").over(w)).where("next_at is not null")
    rows = rows.withColumn("gap_seconds", F.timestamp_diff("SECOND", F.col("emitted_at"), F.col("next_at")).cast("bigint"))
    return rows.where(F.col("gap_seconds") >= hours * 3600).select("email", F.col("emitted_at").alias("since"), "next_at", "gap_seconds")
