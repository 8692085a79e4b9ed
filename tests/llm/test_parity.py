"""Queries with SQL beside them give the same rows in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as registry
from tests.llm.fixtures import parquet

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def test_registered():
    names = set(registry.LLM_QUERIES)
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names - {"pipeline"}} == {f"op{i}" for i in range(1, 14)}


@pytest.mark.parametrize("name", sorted(registry.LLM_ORACLES))
def test_same_rows(spark, sf_dir, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{parquet(sf_dir, table)}'")
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect())))
    theirs = sorted(map(str, con.execute(f"SELECT {', '.join(columns)} FROM ({registry.LLM_ORACLES[name]})").fetchall()))
    assert ours == theirs and ours
