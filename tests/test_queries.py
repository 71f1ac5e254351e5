"""Every core query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from arrayloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(x, y):
    both_nan = isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y)
    return type(x) is type(y) and (x == y or both_nan)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)
    assert got
    if sql := catalog.oracle_sql().get(name):
        out = duck.sql(sql)
        assert sorted(out.columns) == names
        at = [out.columns.index(c) for c in names]
        want = sorted((tuple(r[i] for i in at) for r in out.fetchall()), key=str)
        assert len(got) == len(want)
        assert all(same(x, y) for g, w in zip(got, want, strict=True) for x, y in zip(g, w, strict=True))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
