"""Queries of this subpackage that SQL can express, against DuckDB."""

from collections import Counter

import duckdb
import pytest

from pagecrest.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, rel = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    assert got.columns == rel.columns
    assert Counter(map(tuple, got.collect())) == Counter(rel.fetchall())
