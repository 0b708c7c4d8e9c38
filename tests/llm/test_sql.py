"""The queries that SQL can express, against their twins."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from ledgerloom.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, name):
    sf = "/root/testdata/sf0.01" if name != "op8_decontaminate" else "/root/testdata/sf0.001"
    con = duckdb.connect()
    for file in os.listdir(sf):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{sf}/{file}'")
    df = queries.queries()[name](spark, sf)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(cursor.fetchall())
