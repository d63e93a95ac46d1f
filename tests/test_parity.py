"""Every catalogue query against its SQL in DuckDB on the smallest tables; the others must run."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from ragspark.plans import catalogue, source_queries  # noqa: F401  the latter adds its queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def canonical(df):
    def show(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, str):
            return v
        return f"{float(v) + 0.0:.6f}" if hasattr(v, "__float__") else str(v)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(show, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.SQL:
        assert canonical(got) == canonical(duck.execute(catalogue.SQL[name]).fetchdf())
    else:
        assert len(got.columns) > 0


def test_most_queries_have_sql():
    assert len(catalogue.SQL) > 120 and len(catalogue.QUERIES) - len(catalogue.SQL) < 10
