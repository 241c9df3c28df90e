"""Every query outside llm against its SQL."""

import glob
import os

import duckdb
import pytest

from brindle.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def rows(df, names):
    df = df[names].astype(object)
    return sorted(map(tuple, df.where(df.notna(), None).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, sf, con, name):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), con.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    assert rows(got, names) == rows(want, names)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[0] == "c_custkey"
