"""Every query of the registry against its SQL, on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from veriloom.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, decimal.Decimal | float | np.floating):
        return round(float(v), 6)
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, np.integer):
        return int(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return tuple(map(plain, v)) if isinstance(v, list | tuple | np.ndarray) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, data, name):
    df = QUERIES[name](spark, data)
    wanted = con.execute(ORACLES[name])
    names = [d[0] for d in wanted.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted(([plain(r[c]) for c in sorted(names)] for r in df.collect()), key=str)
    rows = sorted(([plain(r[names.index(c)]) for c in sorted(names)] for r in wanted.fetchall()), key=str)
    assert got == rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).columns
