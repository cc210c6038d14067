"""Every registered query against its SQL statement in DuckDB, on whole tables."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    yield con
    con.close()


def cell(value):
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def compare(spark, duck, name):
    df = contract.queries()[name](spark, SF_DIR)
    rows, columns = df.collect(), sorted(df.columns)
    assert rows, "a query must return rows"
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return
    found = duck.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(cell(r[names.index(c)]) for c in columns) for r in found.fetchall())
    got = sorted(tuple(cell(r[c]) for c in columns) for r in rows)
    assert got == want


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, duck, name):
    compare(spark, duck, name)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_keys_of_both_dictionaries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
