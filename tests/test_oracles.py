"""Every query against its DuckDB oracle at the smallest scale."""

import datetime
import math

import duckdb
import pytest

from codestrata.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, db, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted((repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()))
    if name not in registry.oracle_sql():
        assert rows
        return
    o = db.sql(registry.oracle_sql()[name])
    assert sorted(o.columns) == columns
    at = [o.columns.index(c) for c in columns]
    assert rows == sorted(repr(tuple(plain(r[i]) for i in at)) for r in o.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())
