"""Every query with SQL equals DuckDB's result at the smallest scale."""

import os

import duckdb
import pytest

from tillroll.plans import queries as plans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: str(v)[:19] if hasattr(v, "year") else round(v, 6) if isinstance(v, float) else v
    return sorted(repr([clean(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    want = duck.sql(plans.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(want.fetchall(), want.columns)
