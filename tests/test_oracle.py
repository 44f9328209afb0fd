"""Every registered query against its SQL twin in DuckDB, on whole tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as driver

QUERIES, ORACLES = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple("~" if v is None or v != v else repr(v.item() if hasattr(v, "item") else v)
                        for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, small, name):
    ours = QUERIES[name](spark, small).toPandas()
    cur = duck.execute(ORACLES[name])
    theirs = pd.DataFrame(cur.fetchall(), columns=[c[0] for c in cur.description])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) > 0
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    df = driver.entry(spark)
    assert df.count() > 0 and "day_high" in df.columns
