"""Queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from cairnql.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(name, spark, sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(r) for r in df.select(*columns).collect())
    assert got == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall())
