"""Every registered query against its SQL on the smallest tables: columns, rows and values."""

import math
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from tapestream.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def counted(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in found.collect()]
    if name in ORACLE_SQL:
        expected = duck.execute(ORACLE_SQL[name])
        columns = [d[0] for d in expected.description]
        assert sorted(columns) == sorted(found.columns)
        assert counted(rows, found.columns) == counted(expected.fetchall(), columns)
    else:
        assert rows
