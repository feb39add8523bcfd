import glob
import os

import duckdb
import pandas as pd
import pytest
from granary.plans.catalogue import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(frame, columns):
    one = lambda x: "" if x is None or pd.isna(x) else str(x) if isinstance(x, (str, bool)) or type(x).__name__ == "bool_" else f"{float(x):.9g}"
    return sorted(tuple(map(one, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, D).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)
