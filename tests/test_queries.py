"""Every query against its SQL in DuckDB, at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from slatewright.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{float(v):.6f}"
    except (TypeError, ValueError):
        return str(v)


def _rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(_cell, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = _rows(QUERIES[name](spark, DATA).toPandas())
    if name in ORACLE_SQL:
        assert got == _rows(duck.execute(ORACLE_SQL[name]).fetchdf())
    else:
        assert got[1]
