"""The queries that SQL can express against their SQL, run by DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from trendloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(d, t)}.parquet'")
    got, want = queries.QUERIES[name](spark, d).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = [f[columns].astype(str).sort_values(columns).reset_index(drop=True) for f in (got, want)]
    pd.testing.assert_frame_equal(*rows)
