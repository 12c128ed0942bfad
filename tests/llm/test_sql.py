"""Queries of this subpackage that SQL can express, against it."""

import os

import duckdb
import pytest

from tapestream.llm.queries import ORACLE_SQL, QUERIES

from ..test_oracle import counted

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    found = QUERIES[name](spark, SF)
    expected = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in expected.description]
    assert sorted(columns) == sorted(found.columns)
    assert counted([tuple(r) for r in found.collect()], found.columns) == counted(expected.fetchall(), columns)
