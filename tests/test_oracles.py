"""Every registered query with SQL gives the rows that the SQL gives."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from quern import registry

DATA = "/root/testdata/sf0.001"


def rows(df):
    def text(v):
        if isinstance(v, (list, np.ndarray)):
            return str(list(v))
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, (float, np.floating)) and np.isnan(v)):
            return "~"
        return f"{float(v):.6g}" if isinstance(v, (float, np.floating)) else str(v)

    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    assert len(got)
    if name in registry.oracles():
        assert rows(got) == rows(duck.sql(registry.oracles()[name]).df())


def test_names():
    assert set(registry.oracles()) <= set(registry.queries())
    assert registry.FLAGSHIP in registry.queries()
