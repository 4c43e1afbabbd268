"""Every query against its SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as spark_entry
from compare import TABLES, rows_of

ROWS_ONLY = {"p01_column_profile_approx", "r10_report_json"}


@pytest.fixture(scope="module")
def db(small):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{small}/{name}.parquet'")
    return connection


def test_which_queries_have_no_sql():
    assert set(spark_entry.audit_queries()) - set(spark_entry.oracle_sql()) == ROWS_ONLY
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


@pytest.mark.parametrize("name", sorted(set(spark_entry.audit_queries()) - ROWS_ONLY))
def test_query(spark, small, db, name):
    df = spark_entry.audit_queries()[name](spark, small)
    result = db.execute(spark_entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, result.fetchall())


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_rows_only_query(spark, small, name):
    assert spark_entry.queries()[name](spark, small).count() > 0


def test_entry(spark):
    assert spark_entry.entry(spark).columns == ["instance_id", "penalty", "health_score"]
