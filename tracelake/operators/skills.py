"""Skill usage reports, with protection of small groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: a cell of fewer people is folded away.
FEWEST = 3


def proven() -> Column:
    return (F.col("trust") == "device") & (F.col("origin") == "derived")


def totals(rows: DataFrame) -> DataFrame:
    n = lambda c: F.sum(c.cast("bigint")).cast("bigint")
    return rows.agg(
        F.count("*").alias("invocations"),
        F.countDistinct("plugin", "skill").alias("skills"),
        F.countDistinct("actor_email").alias("people"),
        F.countDistinct("session_ref").alias("sessions"),
        n(F.col("outcome") == "failed").alias("failed"),
        n(F.col("trigger") == "user").alias("by_user"),
        n(proven()).alias("proven"),
    )


def by_bucket(rows: DataFrame, unit: str, admin: bool) -> DataFrame:
    """Per bucket and platform; cells under three people are dropped for members."""
    out = rows.groupBy(F.date_trunc(unit, "occurred_at").cast("date").alias("bucket"), "platform").agg(F.count("*").alias("invocations"), F.countDistinct("actor_email").alias("people"))
    return out if admin else out.where(F.col("people") >= FEWEST)


def folded(cells: DataFrame, keys: list[str], sums: list[str], people: str = "people", dated: str | None = None) -> DataFrame:
    """Rows of fewer than three people become one row 'other': sums added, dates gone."""
    small = F.col(people) < FEWEST
    rows = cells.withColumns({k: F.when(small, "other").otherwise(F.col(k)) for k in keys})
    if dated:
        rows = rows.withColumn(dated, F.when(~small, F.col(dated)))
    return rows.groupBy(*keys).agg(*[F.sum(c).cast("bigint").alias(c) for c in [*sums, people]], *([F.max(dated).alias(dated)] if dated else []))


def by_lineage(rows: DataFrame, prefix: str = "", admin: bool = False) -> DataFrame:
    cells = rows.where(F.col("skill").startswith(prefix)) if prefix else rows
    cells = cells.groupBy("plugin", "skill").agg(F.count("*").alias("invocations"), F.countDistinct("actor_email").alias("people"), F.max("occurred_at").alias("last_used"))
    return cells if admin else folded(cells, ["plugin", "skill"], ["invocations"], dated="last_used")


def by_platform(rows: DataFrame) -> DataFrame:
    cells = rows.groupBy("platform", "origin", "trust").agg(F.count("*").alias("invocations"), F.countDistinct("actor_email").alias("people"))
    return folded(cells, ["platform", "origin", "trust"], ["invocations"])


def by_person(rows: DataFrame) -> DataFrame:
    """Per person: invocations, distinct skills, the most used (by name on a tie) and the platforms."""
    per = rows.groupBy("actor_email", "skill").agg(F.count("*").alias("n"), F.collect_set("platform").alias("p"))
    w = Window.partitionBy("actor_email").orderBy(F.col("n").desc(), "skill")
    top = per.withColumn("rn", F.row_number().over(w))
    return top.groupBy("actor_email").agg(
        F.sum("n").cast("bigint").alias("invocations"),
        F.count("*").alias("skills"),
        F.max(F.when(F.col("rn") == 1, F.col("skill"))).alias("top_skill"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("p")))), ",").alias("platforms"),
    )


def by_repo(rows: DataFrame, most: int = 500) -> DataFrame:
    return rows.groupBy("repo").agg(F.count("*").alias("invocations"), F.countDistinct("skill").alias("skills")).orderBy(F.col("invocations").desc(), "repo").limit(most)


def with_catalog(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each name with one catalog copy: the same plugin first, then by repository name; names without a copy stay."""
    names = rows.select("plugin", "skill").distinct()
    copies = catalog.select(F.col("plugin").alias("c_plugin"), F.col("skill").alias("c_skill"), "source_repo", "entry_id")
    found = names.join(copies, names["skill"] == copies["c_skill"], "left")
    w = Window.partitionBy("plugin", "skill").orderBy((F.col("c_plugin") == F.col("plugin")).desc_nulls_last(), F.col("source_repo").asc_nulls_last(), "entry_id")
    return found.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("plugin", "skill", "source_repo", "entry_id")


def last_used(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    used = rows.groupBy("plugin", "skill").agg(F.max("occurred_at").alias("last_used"), F.countDistinct("actor_email").alias("people"))
    return catalog.join(used, ["plugin", "skill"], "left").withColumn("last_used", F.when(F.col("people") >= FEWEST, F.col("last_used"))).withColumn("people", F.coalesce("people", F.lit(0)))


def unused(rows: DataFrame, catalog: DataFrame, since) -> DataFrame:
    """Catalog entries that nobody invoked since then."""
    return catalog.join(rows.where(F.col("occurred_at") >= F.lit(since)).select("plugin", "skill").distinct(), ["plugin", "skill"], "left_anti")


def pruning(rows: DataFrame, catalog: DataFrame, since, grace_days: int = 5) -> DataFrame:
    """What to do with each unused entry, and why."""
    verdict = F.when(F.col("age_days") < grace_days, "too_new").when(~F.col("installable"), "not_installable").otherwise("archive")
    return unused(rows, catalog, since).select("entry_id", "plugin", "skill", verdict.alias("verdict"), F.when(verdict == "archive", "archive_pr").otherwise("flag_only").alias("action"))


def unknown(rows: DataFrame, catalog: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Invoked names that the catalog does not have, with the first entry of the same bare skill as a suggestion."""
    bad = rows.join(catalog.select("plugin", "skill").distinct(), ["plugin", "skill"], "left_anti")
    cells = bad.groupBy("plugin", "skill").agg(F.count("*").alias("invocations"), F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen"))
    hint = suggestions.groupBy("skill").agg(F.min_by("plugin", F.struct("source_repo", "entry_id")).alias("suggestion"))
    return cells.join(hint, "skill", "left").select("plugin", "skill", "invocations", "first_seen", "last_seen", "suggestion")


def compliance(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Per day and platform: beacon and reconciler rows and their ratio, 1 at most; null where no run covers the day."""
    days = runs.select("platform", F.explode(F.sequence("first_day", "last_day", F.expr("interval 1 day"))).alias("day")).distinct().withColumn("covered", F.lit(True))
    cells = rows.groupBy(F.to_date("occurred_at").alias("day"), "platform").agg(
        F.sum((F.col("origin") == "api").cast("bigint")).alias("beacon"), F.sum((F.col("origin") == "derived").cast("bigint")).alias("reconciler")
    )
    out = cells.join(days, ["day", "platform"], "left")
    reconciler = F.when(F.col("covered"), F.col("reconciler"))
    return out.select("day", "platform", "beacon", reconciler.alias("reconciler"), F.when(reconciler > 0, F.round(F.least(F.lit(1.0), F.col("beacon") / reconciler), 6)).alias("share"))


def merged(rows: DataFrame) -> DataFrame:
    """One row per dedupe key: derived rows over any others; then outcomes only go up, and a composite name beats a bare one."""
    first = F.struct((F.col("origin") != "derived").cast("int").alias("o"), F.col("occurred_at").alias("t"), F.col("id").alias("i"))
    settled = F.when(F.col("outcome").isin("ok", "failed"), F.struct(F.lit(1).alias("s"), F.col("occurred_at").alias("t"), F.col("id").alias("i")))
    return rows.groupBy("dedupe_key").agg(
        F.min_by("origin", first).alias("origin"), F.min_by("id", first).alias("id"), F.coalesce(F.max_by(F.when(settled.isNotNull(), F.col("outcome")), settled), F.lit("started")).alias("outcome"), F.min_by("skill", F.struct((~F.col("skill").contains(":")).cast("int").alias("c"), first.alias("f"))).alias("skill")
    )
