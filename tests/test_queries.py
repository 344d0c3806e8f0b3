"""Every query with SQL against DuckDB on the smallest tables; the others run."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from seamline import plans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    df = plans.QUERIES[name](spark, DATA)
    rows = Counter(repr(tuple(map(plain, r))) for r in df.collect())
    assert len(set(df.columns)) == len(df.columns)
    if name not in plans.ORACLE_SQL:
        assert rows
        return
    want = con.sql(plans.ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert rows == Counter(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())
