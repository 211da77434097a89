"""Filters, access rules, lists and pages over sessions (the read side)."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Session types in display order, and the default page size and its limit.
SESSION_TYPES = ("user", "automation", "internal", "empty")
PAGE, PAGE_MOST = 50, 500


def type_filter(types: Iterable[str] | None) -> Column:
    """None: the default view, which hides empty and internal sessions unless their capture was lost; a list: those types; an empty list: nothing."""
    if types is None:
        return ~F.col("session_type").isin("empty", "internal") | (F.col("head_state") == "capture_loss")
    chosen = [t for t in SESSION_TYPES if t in set(types)]
    return F.col("session_type").isin(chosen) if chosen else F.lit(False)


def can_read(sessions: DataFrame, shares: DataFrame, viewer: str, admin: bool) -> DataFrame:
    """Sessions that the viewer may read: all for an admin, their own, and those with a live share (grantee null: everybody)."""
    if admin:
        return sessions
    live = shares.where(~F.col("revoked") & (F.col("grantee").isNull() | (F.col("grantee") == viewer))).select(F.col("session_owner").alias("user_id")).distinct()
    marked = sessions.join(live.withColumn("shared", F.lit(True)), "user_id", "left")
    return marked.where((F.col("email") == viewer) | F.col("shared")).drop("shared")


def governed(rows: DataFrame, admins: DataFrame, viewer: str) -> DataFrame:
    """Rows whose viewer_emails hold the viewer, or all if the viewer is among the admins: one semi join on a constant."""
    return rows.where(F.array_contains("viewer_emails", viewer)).unionByName(rows.where(~F.array_contains("viewer_emails", viewer)).join(admins.where(F.col("email") == viewer).limit(1).select(F.lit(True).alias("is_admin")), F.lit(True), "left_semi"))


def page_size(n: int | None) -> int:
    return PAGE if not n or n <= 0 else min(n, PAGE_MOST)


def cursor(at: str, key: str) -> str:
    return base64.urlsafe_b64encode(json.dumps({"t": at, "id": key}).encode()).decode().rstrip("=")


def read_cursor(text: str) -> tuple[str, str]:
    """The position a cursor names; a broken one is an error, never the first page."""
    try:
        value = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        return value["t"], value["id"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("invalid cursor") from e


def list_sessions(sessions: DataFrame, types=None, source: str = "", since=None, until=None, query: str = "", after: tuple | None = None, limit: int | None = None) -> DataFrame:
    """Newest first, one row more than the page so that the caller knows whether another follows."""
    rows = sessions.where(type_filter(types))
    if source:
        rows = rows.where(F.col("source") == source)
    if since is not None:
        rows = rows.where(F.col("started_at") >= F.lit(since))
    if until is not None:
        rows = rows.where(F.col("started_at") < F.lit(until))
    if query:
        rows = rows.where(F.col("session_id").ilike(f"%{query}%") | F.col("repo").ilike(f"%{query}%") | F.col("email").ilike(f"%{query}%"))
    if after is not None:
        at, key = F.lit(after[0]).cast(rows.schema["started_at"].dataType), F.lit(after[1])
        rows = rows.where((F.col("started_at") < at) | ((F.col("started_at") == at) & (F.col("session_id") < key)))
    return rows.orderBy(F.col("started_at").desc(), F.col("session_id").desc()).limit(page_size(limit) + 1)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the given order."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rn = 1").drop("rn")


def viewer_emails(owners: DataFrame, principals: DataFrame, domains: tuple[str, str] = ("a.example", "b.example")) -> DataFrame:
    """email, viewer_emails: the owner, the twin under the aliased domain, and principals of the same local part inside the pair; sorted, each once."""
    local = lambda c: F.split_part(c, F.lit("@"), F.lit(1))
    mine = owners.select("email").distinct().withColumn("local", local(F.col("email"))).withColumn("aliased", F.split_part("email", F.lit("@"), F.lit(2)).isin(*domains))
    twins = F.when(F.col("aliased"), F.array(*[F.concat("local", F.lit(f"@{d}")) for d in domains])).otherwise(F.array().cast("array<string>"))
    others = principals.where(F.split_part("email", F.lit("@"), F.lit(2)).isin(*domains)).groupBy(local(F.col("email")).alias("local")).agg(F.collect_set("email").alias("same"))
    rows = mine.join(others, "local", "left")
    return rows.select("email", F.array_sort(F.array_distinct(F.concat(F.array("email"), twins, F.when(F.col("aliased"), F.coalesce("same", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))))).alias("viewer_emails"))
