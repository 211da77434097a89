"""Fleet evaluation: coverage, machines, calls to action, client conditions, drops between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .health import latest_reports, rank


def coverage(devices: DataFrame, reports: DataFrame, since) -> DataFrame:
    """Per person: enrolled devices, reports since then, the last one, and the level that it had."""
    mine = devices.where(~F.col("revoked")).groupBy("email").agg(F.countDistinct("device_id").alias("devices"))
    seen = reports.groupBy("email").agg(
        F.sum((F.col("emitted_at") >= F.lit(since).cast("timestamp_ntz")).cast("bigint")).alias("recent"),
        F.max("emitted_at").alias("last_at"),
        F.max_by("worst", F.struct("emitted_at", "id")).alias("last_worst"),
    )
    return mine.join(seen, "email", "left").select("email", "devices", F.coalesce("recent", F.lit(0)).alias("recent"), "last_at", "last_worst")


def machines(devices: DataFrame, reports: DataFrame, principals: DataFrame) -> DataFrame:
    """Enrolled devices and devices that report, together, without those of disabled people."""
    last = latest_reports(reports.where("device_id is not null")).select("email", "device_id", "emitted_at", "worst")
    rows = devices.where(~F.col("revoked")).select("email", "device_id").distinct().withColumn("enrolled", F.lit(True)).join(last, ["email", "device_id"], "full")
    rows = rows.join(principals.where("disabled").select("email"), "email", "left_anti")
    return rows.select("email", "device_id", F.coalesce("enrolled", F.lit(False)).alias("enrolled"), F.col("emitted_at").alias("last_at"), F.coalesce(F.col("worst"), F.lit("never")).alias("level"))


def calls_to_action(machines_: DataFrame, mutes: DataFrame, now) -> DataFrame:
    """One call per person and kind: how many machines, since when, muted or not; a person's own mute goes before a general one."""
    kind = F.when(F.col("level") == "never", "enrolled_never_seen").when(F.col("level") == "critical", "capture_blocked").when(F.col("level") == "degraded", "degraded")
    rows = machines_.withColumn("kind", kind).where("kind is not null").groupBy("email", "kind").agg(F.count("*").alias("machines"), F.min("last_at").alias("since"))
    live = mutes.where(F.col("until") > F.lit(now).cast("timestamp_ntz"))
    own = live.where("email <> '*'").select("email", "kind").distinct().withColumn("own", F.lit(True))
    general = live.where("email = '*'").select("kind").distinct().withColumn("general", F.lit(True))
    out = rows.join(own, ["email", "kind"], "left").join(general, "kind", "left")
    order = F.when(F.col("kind") == "capture_blocked", 1).when(F.col("kind") == "enrolled_never_seen", 2).otherwise(3)
    return out.select("email", "kind", order.cast("bigint").alias("rank"), "machines", "since", F.coalesce("own", "general", F.lit(False)).alias("muted"))


#: Fixed values, in seconds and shares: when a backlog is old, when deliveries are dead, the grace of a new enrolment, when capture is stale, and how full the spool may be.
BACKLOG_OLD, DELIVERY_DEAD, GRACE, STALE, NEAR_CAP = 3600, 3600, 86_400, 259_200, 0.8


def conditions(r: dict[str, Column]) -> Column:
    """Conditions of a client's report as an array of (kind, level).

    r: free_ok, pending, previous (pending of the report before, null: none),
    oldest_seconds, quarantine, parked, since_success (seconds, null: never),
    uptime, drops, previous_drops (null: not known), bytes, most_bytes, paused,
    clock_ahead.
    """
    waits = F.coalesce(r["pending"], F.lit(0)) > 0
    old = F.coalesce(r["oldest_seconds"], F.lit(0)) > BACKLOG_OLD
    dead = F.coalesce(r["since_success"] > DELIVERY_DEAD, F.lit(False))
    stalled = waits & old & dead
    never = r["since_success"].isNull() & (r["uptime"] > GRACE)
    cases = [
        ("capture_blocked", ~r["free_ok"], F.lit("critical")),
        ("quarantine_nonempty", r["quarantine"] > 0, F.lit("critical")),
        ("parked_nonempty", r["parked"] > 0, F.lit("degraded")),
        ("backlog_stalled", stalled, F.lit("critical")),
        ("backlog_growing", waits & ~stalled & r["since_success"].isNotNull() & ~dead & (r["pending"] > r["previous"]), F.lit("degraded")),
        ("spool_near_cap", (r["most_bytes"] > 0) & (r["bytes"] > 0) & (r["bytes"] >= NEAR_CAP * r["most_bytes"]), F.lit("degraded")),
        ("drops_recorded", (r["drops"] > 0) & (r["drops"] > r["previous_drops"]), F.lit("degraded")),
        ("never_delivered", never, F.when(waits & old, "critical").otherwise("degraded")),
        ("paused", r["paused"], F.lit("info")),
        ("clock_skew", r["clock_ahead"], F.lit("degraded")),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(kind).alias("kind"), level.alias("level"))) for kind, test, level in cases]))


def worst_level(conditions_: Column) -> Column:
    best = F.coalesce(F.array_max(F.transform(conditions_, lambda c: rank(c["level"]))), F.lit(1))
    return F.when(best == 3, "critical").when(best == 2, "degraded").otherwise("ok")


def drops_between(before: DataFrame, after: DataFrame) -> DataFrame:
    """Growth of each reason's sum between two snapshots, where it grew."""
    rows = before.withColumnRenamed("n", "b").join(after.withColumnRenamed("n", "a"), "reason", "full")
    return rows.select("reason", (F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).cast("bigint").alias("grown")).where("grown > 0")


def platform_summary(rows: DataFrame, expected: DataFrame, since) -> DataFrame:
    """Every expected series: the last row and those since then; a series without rows is listed with none."""
    found = rows.groupBy("platform", "origin").agg(F.max("occurred_at").alias("last_at"), F.sum((F.col("occurred_at") >= F.lit(since).cast("timestamp_ntz")).cast("bigint")).alias("recent"))
    return expected.join(found, ["platform", "origin"], "left").withColumn("recent", F.coalesce("recent", F.lit(0)))


def label_counts(rows: DataFrame, unit: str, edges: list[int]) -> DataFrame:
    """A log metric: per window and label the count, and the values' bucket counts."""
    bucket = sum((F.when(F.col("value") >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return rows.groupBy(F.date_trunc(unit, "at").alias("since"), "label", bucket.cast("bigint").alias("bucket")).agg(F.count("*").alias("n"))


def summary(machines_: DataFrame, starts: DataFrame, answers: DataFrame) -> DataFrame:
    """One row of gauges: machines by state, aborted starts and their rate, turns without an answer and their rate."""
    level = lambda x: F.count_if(F.col("level") == x).alias(x)
    a = machines_.agg(F.count("*").alias("machines"), F.count_if("enrolled").alias("enrolled"), level("critical"), level("degraded"), level("ok"), level("never"), F.countDistinct("email").alias("people"))
    b = starts.agg(F.sum("empty").cast("bigint").alias("empty_starts"), F.sum("sessions").cast("bigint").alias("sessions"), F.count_if("alert").alias("start_alerts"))
    c = answers.agg(F.sum("turns").cast("bigint").alias("turns"), F.sum("answered").cast("bigint").alias("answered"))
    rows = a.crossJoin(b).crossJoin(c)  # one row each
    share = lambda x, y: F.round(F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0), 6)
    return rows.withColumn("empty_rate", share("empty_starts", "sessions")).withColumn("missing_rate", F.round(F.when(F.col("turns") > 0, 1 - F.col("answered") / F.col("turns")).otherwise(0.0), 6))
