"""Every registered query of the core against its SQL, on the smallest tables."""

import math
import os

import pytest

from velaspan.plans import queries as plans


@pytest.fixture(scope="module")
def tables(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{data}/{f}')")
    return con


def norm(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return x


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, data, tables, name):
    df = plans.QUERIES[name](spark, data)
    got = rows(df.columns, df.collect())
    if name not in plans.SQL:
        assert got
        return
    cursor = tables.execute(plans.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, cursor.fetchall())


def test_entry(spark, data):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 5
