"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

from sparkburst.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime") or df[c].dtype == object:
            df[c] = df[c].map(lambda v: str(v)[:10] if c == "day" else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    ours, theirs = normal(registry.queries()[name](spark, DATA).toPandas()), normal(duck.execute(registry.oracle_sql()[name]).df())
    assert list(ours.columns) == list(theirs.columns) and len(ours) == len(theirs)
    for c in ours.columns:
        a, b = ours[c], theirs[c]
        if a.dtype.kind in "fiu" and b.dtype.kind in "fiu":
            assert np.array_equal(a.astype(float), b.astype(float), equal_nan=True), c
        else:
            assert a.equals(b), c


def test_others_run(spark):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        assert registry.queries()[name](spark, DATA).count() > 0
