"""Every query with SQL gives the same rows as DuckDB over the same tables."""

import math
import os

import duckdb
import pytest

from tessera.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows):
    cell = lambda x: "NULL" if x is None or (isinstance(x, float) and math.isnan(x)) else f"{x:.5f}" if isinstance(x, float) else str(x)
    return sorted(tuple(cell(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    r = duck.execute(SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    want = [tuple(dict(zip(names, row))[c] for c in columns) for row in r.fetchall()]
    assert plain(tuple(row[c] for c in columns) for row in df.collect()) == plain(want)


def test_entry(spark):
    import __spark_entry__ as e

    if os.path.isdir(SF):
        assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
