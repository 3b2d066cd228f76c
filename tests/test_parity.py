"""Every registered query with SQL gives the same rows as DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from newswarden import plans
from newswarden.fixtures import TABLES

DIR = os.environ.get("PARITY_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, bool) or x is None:
        return str(x)
    return f"{float(x):.9g}" if hasattr(x, "as_integer_ratio") else str(x)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted(tuple(cell(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_rows(spark, duck, name):
    df = plans.QUERIES[name](spark, DIR)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(plans.ORACLES[name])
    want = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, DIR).columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
