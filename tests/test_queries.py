"""Every registered query against its SQL on the smallest tables, and the shape of the registry."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry_module

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(entry_module.queries())


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def tidy(value):
    if isinstance(value, float):
        return repr(value) if value == value else "nan"
    return f"{type(value).__name__}:{value}"


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, sf_dir, name):
    df = entry_module.queries()[name](spark, sf_dir)
    rows = df.collect()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", df._jdf.queryExecution().executedPlan().toString())
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        return
    cursor = db.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    order = [columns.index(c) for c in df.columns]
    want = sorted(tuple(tidy(r[i]) for i in order) for r in cursor.fetchall())
    assert sorted(tuple(tidy(v) for v in r) for r in rows) == want


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert rows and {r["severity"] for r in rows} <= {"LOW", "MEDIUM", "HIGH", "CRITICAL"}


def test_oracles_belong_to_queries():
    assert set(entry_module.oracle_sql()) <= set(NAMES)


def test_no_local_checkpoint_in_the_sources():
    root = os.path.join(os.path.dirname(entry_module.__file__), "tidewatch")
    for folder, _, files in os.walk(root):
        for f in files:
            if f.endswith(".py"):
                assert "localCheckpoint" not in open(os.path.join(folder, f)).read()
