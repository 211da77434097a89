"""Exports by day: planning from a watermark, whole-partition writes, bundles, retention."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import safe_cut

BUNDLE_FIELD_MOST = 16_384


@dataclass(frozen=True)
class Plan:
    """Days to write whole, and how far the watermark moves once all are written."""

    days: tuple[date, ...]
    watermark: datetime


def plan_days(touched: DataFrame, watermark: datetime, until: datetime, most: int) -> Plan:
    """The first days with rows changed after the watermark; the watermark ends with the last of them if more are left."""
    rows = touched.where((F.col("at") > F.lit(watermark)) & (F.col("at") <= F.lit(until))).select(F.to_date("at").alias("day")).distinct().orderBy("day").limit(most + 1).collect()
    days = [r["day"] for r in rows]
    if len(days) <= most:
        return Plan(tuple(days), until)
    return Plan(tuple(days[:most]), datetime.combine(days[most - 1], time.max))


def plan_sessions(touched: DataFrame, watermark: datetime, most: int, most_days: int, margin: timedelta = timedelta(0)) -> Plan:
    """Start days of the sessions touched since the watermark, oldest change first.

    Cut by sessions and by days; the watermark stops before the first change left
    out, so that changes of one instant are never split.
    """
    rows = touched.where(F.col("updated_at") > F.lit(watermark)).orderBy("updated_at", "session_id").limit(most + 1).collect()
    days: list[date] = []
    reached = watermark
    for i, r in enumerate(rows):
        day = r["started_at"].date()
        if i == most or (day not in days and len(days) == most_days):
            kept = [x for x in rows[:i] if x["updated_at"] < r["updated_at"]]
            days = list(dict.fromkeys(x["started_at"].date() for x in kept)) or days
            reached = kept[-1]["updated_at"] if kept else watermark
            break
        days += [] if day in days else [day]
        reached = r["updated_at"]
    return Plan(tuple(sorted(days)), max(watermark, reached - margin))


def write_days(rows: DataFrame, path: str, days: tuple[date, ...]) -> None:
    """Each day's partition replaced as a whole; days without rows stay as they are."""
    rows.where(F.col("day").isin(list(days))).repartition("day").write.partitionBy("day").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def run(rows: DataFrame, touched: DataFrame, path: str, state: str, until: datetime, most: int = 40) -> Plan:
    """Plan, write, and only then move the watermark (one small JSON row in the folder `state`)."""
    spark = rows.sparkSession
    plan = plan_days(touched, read_watermark(spark, state), until, most)
    if plan.days:
        write_days(rows, path, plan.days)
    spark.createDataFrame([(json.dumps({"watermark": plan.watermark.isoformat()}),)], "value string").coalesce(1).write.mode("overwrite").text(state)
    return plan


def read_watermark(spark: SparkSession, state: str) -> datetime:
    try:
        rows = spark.read.text(state).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return datetime(1970, 1, 1)
    return datetime.fromisoformat(json.loads(rows[0][0])["watermark"]) if rows else datetime(1970, 1, 1)


def bundle(session: DataFrame, turns: DataFrame, events: DataFrame) -> DataFrame:
    """A session as lines of JSON in order: itself, its turns, its events without compactions and reminders."""
    line = lambda df, part, k1, k2: df.select("session_id", F.lit(part).alias("part"), F.col(k1).cast("string").alias("k1"), F.col(k2).cast("long").alias("k2"), F.to_json(F.struct(*[c for c in df.columns])).alias("line"))
    events = events.where(~F.col("type").isin("compaction", "system_reminder"))
    out = line(session, 0, "session_id", "n_events").unionByName(line(turns, 1, "session_id", "turn_index")).unionByName(line(events, 2, "occurred_at", "seq"))
    return out.orderBy("session_id", "part", "k1", "k2")


def capped(body: Column, paths: list[str], most: int = BUNDLE_FIELD_MOST) -> tuple[list[Column], Column]:
    """Fields of a JSON text cut to `most` bytes, no character cut in two, and the names of those cut."""
    values = [F.get_json_object(body, f"$.{p}") for p in paths]
    cut = F.array_compact(F.array(*[F.when(F.octet_length(v) > most, F.lit(p)) for p, v in zip(paths, values, strict=True)]))
    return [safe_cut(v, most).alias(p) for p, v in zip(paths, values, strict=True)], cut


def put_lines(rows: DataFrame, path: str) -> None:
    """Rows as gzip-compressed lines of JSON."""
    rows.write.mode("overwrite").option("compression", "gzip").json(path)


def replaced_by(dump: DataFrame, path: str, key: str) -> None:
    """An imported dump in place of all rows that its values of the key had before (delete, then insert, as one write of whole partitions)."""
    dump.write.partitionBy(key).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def retained(events: DataFrame, bodies_before, sessions_before, sessions: DataFrame) -> DataFrame:
    """Events after retention: old bodies become tombstones, events of deleted sessions go."""
    alive = sessions.where(F.col("ended_at") >= F.lit(sessions_before)).select("session_id")
    rows = events.join(alive, "session_id", "left_semi")
    return rows.withColumn("body", F.when(F.col("occurred_at") < F.lit(bodies_before), F.lit('{"expired":true}')).otherwise(F.col("body")))


def anonymised(skills: DataFrame, gone: DataFrame) -> DataFrame:
    """Skill rows of deleted sessions lose who and where, and stay counted."""
    marked = skills.join(gone.select("session_ref").distinct().withColumn("gone", F.lit(True)), "session_ref", "left")
    hide = lambda c: F.when(F.col("gone"), F.lit(None)).otherwise(F.col(c)).alias(c)
    return marked.select("id", hide("actor_email"), hide("repo"), "skill", "occurred_at")
