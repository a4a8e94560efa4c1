from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from tidemark import plans


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    return round(float(v), 6) + 0.0 if isinstance(v, (int, float)) else str(v)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_sql(spark, duck, small, name):
    df = plans.QUERIES[name](spark, small)
    cols = sorted(df.columns)
    rows = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=repr)
    if name in plans.ORACLE_SQL:
        found = duck.execute(plans.ORACLE_SQL[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == cols
        assert rows == sorted(([plain(x[names.index(c)]) for c in cols] for x in found.fetchall()), key=repr)
    else:
        assert rows


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
