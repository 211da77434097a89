"""Every registered query of the engine against its SQL, and the registry itself."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__
from tests.conftest import SMALL
from tracelake import registry, registry_more  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "~"
    if isinstance(value, float):
        return repr(round(value, 6)).removesuffix(".0")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in registry.ORACLE_SQL:
        assert got
        return
    result = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())


def test_entry_and_keys(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scrub_redacts_every_token(spark, tmp_path):
    """The digests of these ids begin with few different digits: with eight characters behind them, their tokens were below the entropy floor."""
    ids = [498224, 602591, 665782, 2760241, 3397482]
    rows = spark.read.parquet(f"{SMALL}/events.parquet").limit(len(ids)).toPandas()
    rows["event_id"] = ids
    spark.createDataFrame(rows).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    wanted = con.execute(f"select id, text, found from ({registry.ORACLE_SQL['q_scrub']})").fetchall()
    assert sorted(tuple(r) for r in registry.QUERIES["q_scrub"](spark, str(tmp_path)).select("id", "text", "found").collect()) == sorted(wanted)
