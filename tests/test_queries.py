"""Every query with an SQL form against that form in DuckDB, on the smallest tables."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__
from ledgerloom.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, (bytes, bytearray, memoryview)):
        return bytes(x).hex()
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i].lower())
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_against_sql(spark, duck, sf, name):
    got = plans.QUERIES[name](spark, sf)
    want = duck.execute(plans.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(n.lower() for n in got.columns) == sorted(n.lower() for n in names)
    want, have = rows_of(want.fetchall(), names), rows_of([tuple(r) for r in got.collect()], got.columns)
    assert have == want
    assert want or name in ("filter_empty_in",)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_queries_without_sql_run(spark, sf):
    for name in set(plans.QUERIES) - set(plans.SQL):
        assert plans.QUERIES[name](spark, sf).count() > 0
