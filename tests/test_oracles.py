"""Every query with SQL against DuckDB on the smallest tables."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in Path(FOLDER).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    if v is None or v != v:
        return ""
    if isinstance(v, bool):
        return str(v)
    return repr(float(v)) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    got = rows(df.columns, df.collect())
    cur = duck.execute(SQL[name])
    want = rows([c[0] for c in cur.description], cur.fetchall())
    assert sorted(df.columns) == sorted(c[0] for c in cur.description)
    assert got == want


def test_contract(spark):
    assert set(SQL) <= set(entry.queries())
    assert entry.entry(spark).columns == ["coin", "day_ms", "side", "price_e8", "qty_e8"]
