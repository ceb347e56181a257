"""Every query with SQL against DuckDB on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int) or isinstance(v, (float, decimal.Decimal)) and v == int(v):
        return str(int(v))
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.5g}"
    if isinstance(v, datetime.datetime):
        return str(v)[:10]
    return str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, db, name):
    got = registry.QUERIES[name](spark, SF)
    rel = db.sql(registry.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(rel.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    at = [rel.columns.index(c) for c in columns]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
