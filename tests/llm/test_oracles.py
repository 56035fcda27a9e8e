"""Queries that SQL can express against their SQL in DuckDB."""

import duckdb
import pytest

from logframe.llm.queries import oracle_sql, queries

from .conftest import SF_DIR


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    wanted = connection.execute(oracle_sql()[name])
    columns = sorted(d[0] for d in wanted.description)
    names = [d[0] for d in wanted.description]
    rows = [dict(zip(names, row)) for row in wanted.fetchall()]
    got = [r.asDict() for r in queries()[name](spark, SF_DIR).collect()]
    assert sorted(got[0]) == columns
    plain = lambda found: sorted(str([r[c] for c in columns]) for r in found)
    assert plain(got) == plain(rows)
