"""Ranked full-text search over messages.

Terms are matched on stemmed tokens; the score is a plain term frequency with
boosts, which orders results but is no other engine's number.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STOP = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
CANDIDATES = 500
_SUFFIX = "(ingly|edly|ing|edly|ed|ly|ies|es|s)$"


@dataclass(frozen=True)
class Query:
    """Alternatives (or) of all-of groups; words to leave out; phrases to hold."""

    groups: tuple[tuple[str, ...], ...]
    without: tuple[str, ...]
    phrases: tuple[str, ...]


def stem(word: str) -> str:
    short = re.sub(_SUFFIX, "", word)
    return short if len(short) >= 3 else word


def parse(text: str) -> Query:
    """Web-search syntax: words are all wanted, "phrases" as they stand, `or` between alternatives, -word never."""
    groups, without, phrases = [[]], [], []
    for m in re.finditer(r'(-?)"([^"]*)"|(\S+)', text.lower()):
        if m[2] is not None:
            words = re.findall(r"\w+", m[2])
            (without if m[1] else groups[-1]).extend(stem(w) for w in words if w not in STOP)
            if not m[1] and words:
                phrases.append(" ".join(words))
        elif m[3] == "or":
            groups.append([])
        else:
            words = [stem(w) for w in re.findall(r"\w+", m[3]) if w not in STOP]
            (without if m[3].startswith("-") else groups[-1]).extend(words)
    return Query(tuple(tuple(g) for g in groups if g), tuple(without), tuple(phrases))


def tokens(text: Column) -> Column:
    """Stemmed tokens of a text, as the stored column has them."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"))
    return F.transform(words, lambda w: F.when(F.length(F.regexp_replace(w, _SUFFIX, "")) >= 3, F.regexp_replace(w, _SUFFIX, "")).otherwise(w))


def matches(query: Query, column: str = "tokens", text: str = "text") -> Column:
    any_of = F.lit(False)
    for group in query.groups:
        all_of = F.lit(True)
        for t in group:
            all_of = all_of & F.array_contains(column, t)
        any_of = any_of | all_of
    for t in query.without:
        any_of = any_of & ~F.array_contains(column, t)
    for p in query.phrases:
        any_of = any_of & F.lower(text).contains(p)
    return any_of


def _times(column: str, term: str) -> Column:
    return F.size(F.filter(column, lambda w: w == term))


def search(messages: DataFrame, text: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """The best of the newest 500 matches: term frequency, weighted by role; whether the candidates were capped."""
    query = parse(text)
    hits = messages.withColumn("tokens", tokens(F.col("text"))).where(matches(query)).orderBy(F.col("occurred_at").desc(), "event_id").limit(CANDIDATES)
    terms = sorted({t for g in query.groups for t in g})
    frequency = sum((_times("tokens", t) for t in terms), F.lit(0))
    boost = F.when(F.col("kind").isin("human", "slash_command"), 2.0).when(F.col("final"), 1.8).when(F.col("role") == "assistant", 1.3).otherwise(1.0)
    scored = hits.withColumn("score", F.round(boost * frequency / (F.lit(1) + F.log(F.size("tokens") + F.lit(1.0))), 6))
    return scored.orderBy(F.col("score").desc(), F.col("occurred_at").desc(), "event_id").offset(offset).limit(limit).select("event_id", "session_id", "score")


def snippet(text: Column, term: str, width: int = 120) -> Column:
    """Around the first place of the term, a third of the width before it."""
    at = F.instr(F.lower(text), term)
    start = F.greatest(F.lit(1), at - F.lit(width // 3))
    return F.when(at > 0, F.substring(text, start, F.lit(width))).otherwise(F.left(text, F.lit(width)))


def candidates(messages: DataFrame, text: str, readable: DataFrame, most: int = CANDIDATES, types: list[str] | None = None) -> DataFrame:
    """The newest matches among the sessions that may be read, of the wanted types; capped tells whether there were more."""
    seen = readable if types is None else readable.where(F.col("session_type").isin(types))
    hits = messages.withColumn("tokens", tokens(F.col("text"))).where(matches(parse(text))).join(seen.select("session_id", "email"), "session_id")
    return hits.orderBy(F.col("occurred_at").desc(), "event_id").limit(most)


def capped_count(hits: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """How many hits there are, and whether the cap cut them."""
    return hits.limit(most).agg(F.count("*").alias("hits")).withColumn("capped", F.col("hits") >= most)


def audit(hits: DataFrame, viewer: str) -> DataFrame:
    """One row for each session of somebody else in the hits."""
    return hits.where(F.col("email") != viewer).select("session_id").distinct().withColumn("viewer", F.lit(viewer))


def hits_on_list(listed: DataFrame, hits: DataFrame) -> DataFrame:
    """Listed sessions with their first hit, and after them the sessions that only have a hit."""
    w = Window.partitionBy("session_id").orderBy(F.col("score").desc(), F.col("occurred_at").desc(), "event_id")
    first = hits.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("session_id", "event_id", "score")
    return listed.select("session_id", F.lit(True).alias("listed")).join(first, "session_id", "full").withColumn("listed", F.coalesce("listed", F.lit(False)))


def highlighted(text: Column, terms: list[str], most: int = 20) -> Column:
    """Segments of a text as (text, marked): the first places of the terms, the longest term first, at most so many marks."""
    quoted = sorted(map(re.escape, terms), key=len, reverse=True)
    parts = F.regexp_extract_all(text, F.lit(f"(?is)({'|'.join(quoted)}|(?:(?!{'|'.join(quoted)}).)+)"))
    pieces = F.transform(parts, lambda p: F.struct(p.alias("text"), p.rlike(f"(?is)^(?:{'|'.join(quoted)})$").alias("marked")))
    shown = F.transform(pieces, lambda p, i: F.struct(p["text"].alias("text"), (p["marked"] & (F.size(F.filter(F.slice(pieces, F.lit(1), i + 1), lambda q: q["marked"])) <= most)).alias("marked")))
    return shown
