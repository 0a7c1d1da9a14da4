"""Every query with an SQL twin against DuckDB on the smallest tables; every other one runs."""

import math
from pathlib import Path

import duckdb
import pytest

from inkwell.oracle import ORACLE_SQL
from inkwell.queries import QUERIES
from tests.conftest import SMALL


def _norm(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(map(_norm, r)) for r in df[names].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SMALL).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SMALL).toPandas()
    if name in ORACLE_SQL:
        assert rows(found) == rows(duck.execute(ORACLE_SQL[name]).df())
    else:
        assert len(found)
