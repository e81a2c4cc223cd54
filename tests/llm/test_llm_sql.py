"""Queries of the subpackage that have SQL give what DuckDB gives."""

from pathlib import Path

import duckdb
import pytest

from tallyfield.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_is_its_sql(spark, sf, name):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    df, want = QUERIES[name](spark, sf), con.sql(ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    row = lambda r: tuple(repr(r[c]) for c in cols)
    assert sorted(row(r.asDict()) for r in df.collect()) == sorted(row(dict(zip(want.columns, r))) for r in want.fetchall())
