"""Every domain query against its SQL in DuckDB, on the smallest tables."""

import os
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from quillroster.plans import flows, queries  # noqa: F401 - both register their queries
from quillroster.plans.registry import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def plain(row):
    return tuple(round(float(v), 6) if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else v for v in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = Counter(plain(r) for r in want.select(*[f'"{c}"' for c in got.columns]).fetchall())
    assert Counter(plain(r) for r in got.collect()) == rows
