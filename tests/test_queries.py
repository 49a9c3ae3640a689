"""Every query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from octetflow.plans import oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM '{p}'")
    return c


def rows(names, found):
    at = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(repr(round(r[k], 9) if isinstance(r[k], float) else r[k]) for k in at) for r in found)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_as_sql(spark, sql, name):
    df, want = queries.QUERIES[name](spark, SF), sql.sql(oracles.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracles.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(oracles.ORACLES) <= set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
