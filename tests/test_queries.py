"""Every query of the domain against its DuckDB oracle at the smallest scale."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from langshift.adapters import BASE
from langshift.oracles import ORACLES
from langshift.queries import QUERIES

SF = "/root/testdata/sf0.001"
#: Queries without SQL: their parts have it, and they are held against inline tables.
WITHOUT = {"backfill"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NA or (isinstance(value, float) and value != value):
        return "~"
    if isinstance(value, bool | np.bool_):
        return str(bool(value))
    return f"{float(value):.9g}" if isinstance(value, int | float | np.number) else str(value)


def table(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(plain(v) for v in row) for row in frame.itertuples(index=False))


def test_each_query_has_an_oracle_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == WITHOUT and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    found, expected = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert table(found) == table(expected)


@pytest.mark.parametrize("name", sorted(WITHOUT))
def test_query_without_oracle_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
