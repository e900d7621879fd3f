"""The SQL of the queries here equals them on the smallest tables."""

import os

import duckdb
import pytest

from tessella.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    df = queries.queries()[name](spark, DATA)
    cursor = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted((tuple(r) for r in cursor.fetchall()), key=repr)
    assert expected and sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == expected
