"""Every registered query against its SQL in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from workload.oracles import oracle_sql
from workload.queries import queries

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("events", "documents"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    text = frame.astype(object).where(frame.notna(), None).map(lambda v: "null" if v is None else str(v).removesuffix(".0"))
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def test_same_names():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR)
    wanted = duck.execute(SQL[name])
    types = {d[0]: str(d[1]) for d in wanted.description}
    found = dict(got.dtypes)
    spark_types = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean"}
    assert {c: spark_types.get(t, t) for c, t in types.items()} == found
    expected = wanted.df()
    assert len(expected) > 0
    pd.testing.assert_frame_equal(canonical(got.toPandas()), canonical(expected))
