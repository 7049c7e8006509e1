"""Every registered query equals its defining SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def same(u, v):
    if u == v:
        return True
    numbers = (int, float)
    if isinstance(u, numbers) and isinstance(v, numbers) and not isinstance(u, bool):
        return math.isclose(u, v, rel_tol=1e-6, abs_tol=2e-6)
    return False


def key(row):
    return tuple((v is not None, f"{v:.4f}" if isinstance(v, float) else str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_query_matches_sql(spark, sf, duck, name):
    df = entry_module.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=key)
    rel = duck.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    idx = [names.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in idx) for r in rel.fetchall()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(same(u, v) for u, v in zip(a, b)), (a, b)


def test_entry(spark):
    assert entry_module.entry(spark).count() == 6


def test_names():
    names = set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= names
    assert len(names) > 250
