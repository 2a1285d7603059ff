"""Queries against the same in SQL, at the smallest size."""

import datetime as dt
import math
import os
from collections import Counter

import duckdb
import pytest

from tsqc.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v.isoformat() if isinstance(v, dt.datetime) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    got = Counter(tuple(str(plain(v)) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert got == Counter(tuple(str(plain(v)) for v in r) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry_has_every_query():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())
