import os

import pytest

from loomlake.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    frame = queries.queries()[name](spark, DATA)
    columns = frame.columns
    found = connection.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})")
    assert sorted(map(repr, found.fetchall())) == sorted(repr(tuple(r)) for r in frame.collect())


def test_names():
    names = list(queries.queries())
    assert [n for n in names if n.startswith("op")] == sorted((n for n in names if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11)) and "pipeline" in names
