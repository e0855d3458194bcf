import os

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_its_sql(spark, tables, name):
    ours = contract.queries()[name](spark, FOLDER).toPandas()
    theirs = tables.execute(contract.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) > 0
    assert canonical(ours) == canonical(theirs)


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    rows = contract.queries()[name](spark, FOLDER).collect()
    assert rows


def test_alerts_hold_each_column_once(spark):
    alerts = contract.queries()["stream_alerts"](spark, FOLDER)
    assert alerts.columns[-3:] == ["total_bytes", "alert_text", "batch"] and alerts.columns.count("batch") == 1
    assert sorted(r.batch for r in alerts.select("batch").collect()) == [0] * 5 + [1] * 5 + [2] * 5


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 5
    assert [r.line_id for r in rows] == sorted(r.line_id for r in rows)
    assert {r.alert_text for r in rows} == {"predicted to be an anomaly"}


def test_every_sql_has_its_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
