"""Every query against its SQL over the smallest tables, as values."""

import os
from decimal import Decimal

import duckdb
import pytest

from quern.plans import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return c


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return str(x)
    if isinstance(x, (int, float, Decimal)):
        return f"{float(x):.6f}"
    return str(x)


def same(got, want, columns):
    names = list(want.columns)
    assert sorted(columns) == sorted(names)
    order = sorted(columns)
    a = sorted([tuple(plain(r[c]) for c in order) for r in got])
    b = sorted([tuple(plain(r[names.index(c)]) for c in order) for r in want.fetchall()])
    assert a == b


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, data, name):
    df = catalog.queries()[name](spark, data)
    same(df.collect(), duck.sql(SQL[name]), df.columns)


@pytest.mark.parametrize("name", sorted(set(catalog.NAMES) - set(SQL)))
def test_runs(spark, data, name):
    df = catalog.queries()[name](spark, data)
    assert df.columns
    assert df.count() > 0
