"""Every query that has SQL gives the rows of that SQL."""

import glob
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].map(lambda v: "NULL" if v is None or (isinstance(v, float) and np.isnan(v)) else f"{v:.6f}" if isinstance(v, (float, np.floating)) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_against_sql(spark, db, name):
    ours, sql = normal(entry.queries()[name](spark, SF).toPandas()), normal(db.execute(entry.oracle_sql()[name]).fetch_df())
    assert list(ours.columns) == list(sql.columns)
    assert ours.equals(sql)


def test_flagship_query(spark):
    assert entry.entry(spark).count() > 0
