"""The SQL of the operators that have one, against the queries, in DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest
from test_parity import canonical

from ragspark.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(Q.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    assert canonical(Q.queries()[name](spark, SF).toPandas()) == canonical(con.execute(Q.SQL[name]).fetchdf())
