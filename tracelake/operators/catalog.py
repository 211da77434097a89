"""The skill catalog: publishing, aliases, checks, reconciler runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KEY = ["plugin", "skill"]


def published(old: DataFrame, new: DataFrame) -> DataFrame:
    """The catalog after a publish: new entries and changed digests come in, entries that are missing are retired and stay."""
    a = old.select(*_KEY, F.col("digest").alias("old_digest"), F.col("present").alias("was"))
    b = new.select(*_KEY, F.col("digest").alias("new_digest"))
    rows = a.join(b, _KEY, "full")
    here = F.col("new_digest").isNotNull()
    change = F.when(F.col("old_digest").isNull(), "added").when(~here, F.when(F.col("was"), "retired").otherwise("absent")).when(~F.col("was"), "returned").when(F.col("old_digest") != F.col("new_digest"), "changed").otherwise("same")
    return rows.select(*_KEY, F.coalesce("new_digest", "old_digest").alias("digest"), here.alias("present"), change.alias("change"))


def shrink(old: DataFrame, new: DataFrame) -> DataFrame:
    """How many present entries a publish would retire, of how many."""
    present = old.where("present")
    return present.join(new.select(*_KEY).distinct().withColumn("stays", F.lit(True)), _KEY, "left").agg(F.count("*").alias("present"), F.sum(F.col("stays").isNull().cast("bigint")).alias("retiring"))


def aliases(catalog: DataFrame) -> DataFrame:
    """Names by which an entry can be called: plugin:skill and the bare skill."""
    return catalog.select("entry_id", F.explode(F.array(F.concat("plugin", F.lit(":"), "skill"), F.col("skill"))).alias("alias"))


def alias_conflicts(catalog: DataFrame) -> DataFrame:
    """Names that more than one entry claims."""
    return aliases(catalog).groupBy("alias").agg(F.countDistinct("entry_id").alias("entries")).where("entries > 1")


def mismatched_runs(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """Reconciler runs whose own count differs from the rows stored for their days."""
    hit = runs.join(rows.select(F.col("platform").alias("p"), F.to_date("occurred_at").alias("day")), (F.col("platform") == F.col("p")) & F.col("day").between(F.col("first_day"), F.col("last_day")), "left")
    return hit.groupBy("run_id", "counted").agg(F.count("p").alias("stored")).where("counted <> stored")
