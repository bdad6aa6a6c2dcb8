"""Every registered query against its SQL over the small tables."""

import collections
import os

import duckdb
import pytest

from textloom.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = collections.Counter(tuple(r) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    cols = ", ".join(f'"{c}"' for c in columns)
    wanted = collections.Counter(con.execute(f"SELECT {cols} FROM ({ORACLES[name]})").fetchall())
    assert sum(wanted.values()) > 0
    assert found == wanted
