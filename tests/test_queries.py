"""Every query with SQL text gives the rows that DuckDB gives, at the smallest size; the others run."""

import duckdb
import pytest

from lumenquarry.plans.base import SQL
from lumenquarry.plans.catalog import queries
from lumenquarry.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in TABLES:
        con.sql(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    return con


def plain(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries()))
def test_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    rows = df.collect()
    if name not in SQL:
        return
    columns = sorted(df.columns)
    want = duck.sql(SQL[name])
    names = want.columns
    assert sorted(names) == columns
    got = sorted(tuple(plain(r[c]) for c in columns) for r in rows)
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall())
