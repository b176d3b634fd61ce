"""Every bound query against an independent engine on the same tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as driver
from orrery import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    def text(v):
        if isinstance(v, float):
            return repr(round(v, 9) + 0.0)
        return str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(plans.oracles()))
def test_query_equals_sql(spark, db, name):
    df = plans.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    result = db.execute(plans.oracles()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, result.fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_registry():
    assert set(driver.oracle_sql()) <= set(driver.queries())
