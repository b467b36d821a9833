"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: "null" if v is None else repr(round(float(v), 6)) if isinstance(v, float) else str(v)
    return sorted(names), sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = entry.queries()[name](spark, DATA)
    got = canonical(df.columns, df.collect())
    if name in ORACLE_SQL:
        want = tables.execute(ORACLE_SQL[name])
        assert got == canonical([d[0] for d in want.description], want.fetchall())
    else:
        assert got[1]


def test_entry(spark):
    assert entry.entry(spark).columns == ["label", "n_tiles"]
