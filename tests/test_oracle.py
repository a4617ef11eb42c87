"""Every query with SQL equals it: names, rows and values, whatever the order."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from tidefold.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (bytearray, bytes)):
        return bytes(v).hex()
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(plain(r[i])) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    found = duck.sql(registry.ORACLE[name])
    assert sorted(df.columns) == sorted(found.columns)
    got = rows(df.columns, df.collect())
    assert got == rows(found.columns, found.fetchall())
    if name not in ("truncate_table",):
        assert got
