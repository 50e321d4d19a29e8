"""Queries of the subpackage that SQL can express, against DuckDB."""

import duckdb
import pandas as pd
import pytest

from tidemark.llm.queries import ORACLE_SQL, QUERIES


def rows(df):
    return sorted(tuple("null" if pd.isna(v) else repr(float(v)) if isinstance(v, (int, float)) else v for v in r) for r in df.astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(name, spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.sql(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got[columns]) == rows(want[columns])


def test_every_dealt_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
