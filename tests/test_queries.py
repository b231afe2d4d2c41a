"""Every registered query with SQL gives the same rows in Spark and DuckDB; the others run."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.verify import TABLES, shape

OWN = {k: f for k, f in entry.queries().items() if not k.startswith("op") and k != "pipeline"}


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(name, spark, sf, db):
    got = shape(OWN[name](spark, sf).toPandas())
    sql = entry.oracle_sql().get(name)
    if sql:
        want = shape(db.sql(sql).df())
        assert got[:2] == want[:2]
        assert got[3] == want[3]
    else:
        assert got[1] > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
