"""Every registered query that has SQL agrees with it, on the smallest tables."""

import os

import pytest

from jurata import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return round(x, 6)
    if hasattr(x, "as_tuple"):
        return int(x)
    if hasattr(x, "isoformat"):
        return str(x)
    return tuple(x) if isinstance(x, list) else x


def same(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in at) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rows = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.execute(sql)
    assert same(df.columns, rows) == same([c[0] for c in found.description], found.fetchall())


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 60
