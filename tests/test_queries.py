"""The named queries against their DuckDB SQL at the smallest scale; skipped where the driver's tables are missing."""

import importlib
import math
import os

import duckdb
import pytest

DIR = "/root/testdata/sf0.001"
TABLES = [t for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split() if os.path.exists(f"{DIR}/{t}.parquet")]
pytestmark = pytest.mark.skipif("events" not in TABLES, reason="no test tables")
entry = importlib.import_module("__spark_entry__")
SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(x, 9) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    df = entry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(([cell(r[c]) for c in columns] for r in df.collect()), key=repr)
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    rel = db.sql(SQL[name])
    order = [rel.columns.index(c) for c in columns]
    assert sorted(rel.columns) == columns
    want = sorted(([cell(r[i]) for i in order] for r in rel.fetchall()), key=repr)
    assert got == want and got


def test_entry(spark):
    assert entry.entry(spark).count() == 9
