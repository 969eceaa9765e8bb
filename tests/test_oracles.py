"""Every query against its SQL in DuckDB on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pytest

from mossgraph.catalog import ORACLE_SQL, QUERIES
from mossgraph.plans.model import TABLES

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        path = f"{FOLDER}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    con = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in con.description]
    wanted = con.fetchall()
    assert sorted(names) == sorted(got.columns)
    rows = got.select(*names).collect()
    key = lambda r: tuple((v is None, str(type(v)), str(v)) for v in r)
    a, b = sorted((tuple(plain(v) for v in r) for r in rows), key=key), sorted((tuple(plain(v) for v in r) for r in wanted), key=key)
    assert len(a) == len(b)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    assert frame.columns
    frame.count()
