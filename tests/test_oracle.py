"""Each query of the library with SQL gives, on the smallest tables, what DuckDB gives."""

import importlib
from pathlib import Path

import duckdb
import pytest

MODULES = ("tables", "accuracy", "probability", "records", "models", "forecasts", "desk", "walk", "upcoming", "merging", "documents")
CASES = [(m, n) for m in MODULES for n in importlib.import_module(f"tallyfield.queries.{m}").ORACLE_SQL]


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize(("module", "name"), CASES, ids=[n for _, n in CASES])
def test_query_is_its_sql(spark, sf, con, module, name):
    m = importlib.import_module(f"tallyfield.queries.{module}")
    df = m.QUERIES[name](spark, sf)
    want = con.sql(m.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    row = lambda r: tuple(repr(r[c]) for c in cols)
    assert sorted(row(r.asDict()) for r in df.collect()) == sorted(row(dict(zip(want.columns, r))) for r in want.fetchall())
