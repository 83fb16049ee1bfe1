"""Every registered record query against its SQL in DuckDB, at the smallest scale."""

from __future__ import annotations

import duckdb
import pytest

from recordmill.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(v, 9) if isinstance(v, float) else v


def rows(data, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows(df.collect(), df.columns)
    r = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(r.fetchall(), names)
