"""Registered queries against DuckDB on the smallest tables: every third here, all of them in the driver's check."""

import math

import duckdb
import pytest

import __spark_entry__
from letterloom.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "~"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES)[::3])
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got.select(*columns).collect()) == plain(want.select(*columns).fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 2
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_no_shuffle_on_the_extraction_path(spark):
    from letterloom.plans import extraction
    from letterloom.sources.letters import letters

    base = letters(spark, SF)
    plan = extraction.process(base.select("filename", "text"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == base._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
