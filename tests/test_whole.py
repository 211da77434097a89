"""Registered queries over small tables that hold the cases the driver's tables lack."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tracelake import registry
from tracelake.operators import activity, skills
from tracelake.plans import export

#: skill1 has three people, skill2 two, skill3 one; nobody used skill4; the catalog does not have skill5.
USED = [(1, 1, 5), (1, 2, 7), (1, 3, 6), (2, 1, 9), (2, 2, 8), (3, 1, 3), (3, 1, 4)]
UNKNOWN = [(5, 1, 2), (5, 4, 9)]


@pytest.fixture
def small(spark, tmp_path):
    return tables(spark, tmp_path, USED)


def tables(spark, tmp_path, used):
    rows = [(i, 1, part, person, "O", "A", 30.0, datetime(1996, 1, day)) for i, (part, person, day) in enumerate(used)]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_linestatus string, l_returnflag string, l_quantity double, l_shipdate timestamp_ntz"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    parts = [(i, brand, 20, 1.0) for i, brand in enumerate(["b", "a", "c", "a"], 1)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def test_small_cells_are_folded(spark, small):
    got = {tuple(r) for r in registry.QUERIES["q_skill_by_lineage"](spark, small).select("plugin", "skill", "invocations", "people", "last_used").collect()}
    assert got == {("plugin1", "skill1", 3, 3, datetime(1996, 1, 7)), ("other", "other", 4, 3, None)}


def test_last_use_of_small_groups_is_hidden(spark, small):
    got = {tuple(r) for r in registry.QUERIES["q_skill_last_used"](spark, small).select("entry_id", "last_used", "people").collect()}
    assert got == {(1, datetime(1996, 1, 7), 3), (2, None, 2), (3, None, 1), (4, None, 0)}


def test_names_are_looked_up_in_the_whole_catalog(spark, tmp_path):
    folder = tables(spark, tmp_path, USED + UNKNOWN)
    got = {tuple(r) for r in registry.QUERIES["q_skill_catalog_copy"](spark, folder).select("plugin", "skill", "source_repo", "entry_id").collect()}
    assert got == {("plugin1", "skill1", "b", 1), ("plugin2", "skill2", "a", 2), ("plugin3", "skill3", "c", 3), ("plugin5", "skill5", None, None)}
    got = {tuple(r) for r in registry.QUERIES["q_skill_unknown"](spark, folder).select("plugin", "skill", "invocations", "first_seen", "last_seen", "suggestion").collect()}
    assert got == {("plugin5", "skill5", 2, datetime(1996, 1, 2), datetime(1996, 1, 9), None)}


def test_other_plugins_entries_are_copies_and_suggestions(spark):
    used = spark.createDataFrame([("p", "x", datetime(1996, 1, 1)), ("q", "x", datetime(1996, 1, 2))], "plugin string, skill string, occurred_at timestamp_ntz")
    entries = spark.createDataFrame([(1, "z", "p", "x"), (2, "b", "r", "x"), (3, "a", "s", "x")], "entry_id long, source_repo string, plugin string, skill string")
    assert {tuple(r) for r in skills.with_catalog(used, entries).collect()} == {("p", "x", "z", 1), ("q", "x", "a", 3)}
    assert [tuple(r) for r in skills.unknown(used, entries, entries).select("plugin", "skill", "invocations", "suggestion").collect()] == [("q", "x", 1, "s")]


def test_bundle_holds_every_turn(spark):
    got = registry.QUERIES["q_bundle"](spark, SMALL).collect()
    events = sorted(spark.read.parquet(f"{SMALL}/events.parquet").select("user_id", "ts", "event_id", "event_type").collect(), key=lambda r: (r["ts"], r["event_id"]))
    turns, at = set(), {}
    for r in events:
        session = f"s{r['user_id']}-{r['ts']:%Y-%m-%d}"
        at[session] = at.get(session, 0) + (r["event_type"] == "signup")
        turns.add((session, at[session]))
    lines = [(r["session_id"], r["k2"]) for r in got if r["part"] == 1]
    assert len(lines) == len(turns) and set(lines) == turns
    assert [r["part"] for r in got if r["session_id"] == lines[0][0]] == sorted(r["part"] for r in got if r["session_id"] == lines[0][0])


def test_turn_lines_of_a_bundle(spark):
    messages = spark.createDataFrame([("s", 1, "user", 10), ("s", 2, "assistant", 11), ("s", 3, "user", 12)], "session_id string, seq long, role string, event_id long")
    session = spark.createDataFrame([("s", 3)], "session_id string, n_events long")
    events = messages.select("session_id", F.col("event_id").alias("occurred_at"), "seq", F.lit("tool_call").alias("type"))
    rows = export.bundle(session, activity.interval_turns(messages), events).collect()
    assert [r["part"] for r in rows] == [0, 1, 1, 2, 2, 2]
    assert [json.loads(r["line"]) for r in rows if r["part"] == 1] == [{"session_id": "s", "turn_index": 1, "messages": 2, "answers": 1, "final_event_id": 11}, {"session_id": "s", "turn_index": 2, "messages": 1, "answers": 0}]
