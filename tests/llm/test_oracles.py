"""Queries with SQL give DuckDB's rows."""

import duckdb
import pytest

from newswarden.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("pages", "labels", "conversations", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    df = QUERIES[name](spark, DIR)
    got, cursor = df.collect(), con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted(cursor.fetchall())
