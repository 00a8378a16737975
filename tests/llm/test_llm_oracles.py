"""The queries that SQL can express, against it."""

import os

import duckdb
import pytest

from veriloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "pages"):
        path = f"{data}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    wanted = con.execute(ORACLES[name])
    names = [d[0] for d in wanted.description]
    df = QUERIES[name](spark, data)
    assert sorted(df.columns) == sorted(names)
    rows = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in wanted.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in sorted(names)) for r in df.collect()), key=str) == rows
    assert name != "op1_chat_tools" or max(r[sorted(names).index("level")] for r in rows) > 0
