"""Every query against the same in SQL, over whole tables."""

import math

import duckdb
import pytest

from fieldloom import catalog

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck(sf):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return db


def cells(rows):
    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return v

    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query_equals_sql(spark, duck, sf, name):
    df = catalog.queries()[name](spark, sf)
    names = sorted(df.columns)
    want = duck.sql(catalog.oracle_sql()[name])
    assert names == sorted(want.columns)
    got = cells(df.select(*[f"`{c}`" for c in names]).collect())
    assert got == cells(want.select(*[duckdb.ColumnExpression(c) for c in names]).fetchall())
