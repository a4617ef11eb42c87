"""Queries with SQL equal it on whole small tables."""

import duckdb
import pytest

from tidefold.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    found = con.sql(queries.ORACLE[name])
    df = queries.QUERIES[name](spark, DATA)
    assert df.columns == found.columns
    assert sorted(map(tuple, df.collect())) == sorted(found.fetchall())
