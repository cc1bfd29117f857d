"""Every registered query of the dialect against its DuckDB equivalent on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from pipewright.plans import examples

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(DIR):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DIR}/{name}'")
    return con


def rows(df):
    plain = lambda v: "" if pd.isna(v) else f"{float(v):.9g}" if isinstance(v, float) or hasattr(v, "as_tuple") else str(v)
    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", examples.oracle_sql())
def test_query(spark, duck, name):
    got = examples.queries()[name](spark, DIR).toPandas()
    want = duck.execute(examples.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
