"""Usage analytics over sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reads import type_filter

SUMS = ("user_turns", "tool_calls", "errors", "tokens", "cost_cents")


def bucket(unit: str, zone: str) -> Column:
    """Start of the day, week or month of started_at on the caller's calendar."""
    if unit not in ("day", "week", "month"):
        raise ValueError(f"unknown unit {unit!r}")
    return F.date_trunc(unit, F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("started_at"))).cast("date").alias("bucket")


def _in_range(sessions: DataFrame, since, until, emails) -> DataFrame:
    rows = sessions if since is None else sessions.where(F.col("started_at") >= F.lit(since))
    rows = rows if until is None else rows.where(F.col("started_at") < F.lit(until))
    return rows if emails is None else rows.where(F.col("email").isin(list(emails)))


def _totals() -> list[Column]:
    return [F.count("*").alias("sessions"), *[F.sum(c).cast("bigint").alias(c) for c in SUMS]]


def daily_usage(sessions: DataFrame, unit: str = "day", zone: str = "UTC", since=None, until=None, emails=None, types=None) -> DataFrame:
    rows = _in_range(sessions, since, until, emails).where(type_filter(types))
    return rows.groupBy(bucket(unit, zone)).agg(F.countDistinct("email").alias("people"), *_totals())


def daily_usage_by_type(sessions: DataFrame, unit: str = "day", zone: str = "UTC", since=None, until=None, emails=None) -> DataFrame:
    """No type filter: the types are what is shown."""
    return _in_range(sessions, since, until, emails).groupBy(bucket(unit, zone), "session_type").agg(*_totals())


def daily_usage_by_person(sessions: DataFrame, emails: list[str], unit: str = "day", zone: str = "UTC") -> DataFrame:
    """At most eight people at a time."""
    if len(emails) > 8:
        raise ValueError("at most eight people")
    return _in_range(sessions, None, None, emails).where(type_filter(None)).groupBy(bucket(unit, zone), "email").agg(*_totals())


def person_usage(sessions: DataFrame, principals: DataFrame, sort: str = "cost_cents", prefix: str = "", n: int = 25) -> DataFrame:
    """Totals per person, the largest first; prefix of email or display name, in any case."""
    if sort not in ("sessions", *SUMS):
        raise ValueError(f"cannot sort by {sort!r}")
    rows = sessions.where(type_filter(None)).groupBy("email").agg(*_totals()).join(principals.select("email", "display_name"), "email", "left")
    if prefix:
        rows = rows.where(F.lower("email").startswith(prefix.lower()) | F.lower("display_name").startswith(prefix.lower()))
    return rows.orderBy(F.col(sort).desc(), "email").limit(max(1, min(n, 200)))


def session_counts(sessions: DataFrame) -> DataFrame:
    return sessions.where(type_filter(None)).groupBy("email").agg(F.count("*").alias("sessions"))


def filter_options(sessions: DataFrame, most: int = 60) -> DataFrame:
    """The first people and the first non-empty repositories, as (kind, value)."""
    people = sessions.select(F.lit("person").alias("kind"), F.col("email").alias("value")).distinct().orderBy("value").limit(most)
    repos = sessions.where("repo <> ''").select(F.lit("repo").alias("kind"), F.col("repo").alias("value")).distinct().orderBy("value").limit(most)
    return people.unionByName(repos)


def dense(buckets: DataFrame, first: str, last: str, sums: list[str], people: str = "people") -> DataFrame:
    """Every calendar day from first to last: sums with 0 where nothing was, people as the maximum; days outside are dropped."""
    spark = buckets.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 day"))).alias("bucket"))
    found = buckets.groupBy("bucket").agg(F.max(people).alias(people), *[F.sum(c).cast("bigint").alias(c) for c in sums])
    return F.broadcast(days).join(found, "bucket", "left").na.fill(0)


def pivoted(rows: DataFrame, key: str, series: str, values: list, measure: str) -> DataFrame:
    """One column per value of the series, 0 where nothing was."""
    return rows.groupBy(key).pivot(series, values).agg(F.sum(measure).cast("bigint")).na.fill(0)


def nice_ceiling(c: Column) -> Column:
    """The least of 1, 2, 5 times a power of ten that is no smaller."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(c)))
    ratio = c / power
    step = F.when(ratio <= 1, 1).when(ratio <= 2, 2).when(ratio <= 5, 5).otherwise(10)
    return F.when(c <= 0, F.lit(1.0)).otherwise(step * power)


def counted_minutes(start: Column, end: Column) -> Column:
    """Whole minutes between two local times without Saturdays and Sundays."""
    days = F.sequence(F.to_date(start), F.to_date(end), F.expr("interval 1 day"))
    seconds = lambda t: F.unix_timestamp(t)
    overlap = lambda d: F.when(
        F.weekday(d) >= 5, F.greatest(F.lit(0), F.least(seconds(end), seconds(F.date_add(d, 1).cast("timestamp"))) - F.greatest(seconds(start), seconds(d.cast("timestamp"))))
    ).otherwise(F.lit(0))
    weekend = F.aggregate(F.transform(days, overlap), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.floor((seconds(end) - seconds(start) - weekend) / 60)
