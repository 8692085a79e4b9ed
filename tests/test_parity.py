"""Every query with SQL beside it gives the same rows in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as registry

# The training-data queries have tests of their own.
QUERIES = {n: q for n, q in registry.queries().items() if n not in registry.LLM_QUERIES}
ORACLES = {n: q for n, q in registry.oracle_sql().items() if n not in registry.LLM_ORACLES}
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _sorted(rows):
    return sorted(rows, key=lambda row: [(v is None, "" if v is None else v) for v in row])


def test_every_oracle_has_a_query():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = _sorted([tuple(row[c] for c in columns) for row in df.collect()])
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = _sorted([tuple(row[i] for i in order) for row in cursor.fetchall()])
    assert ours == theirs
    assert ours


@pytest.mark.parametrize("name", ["fit_random_forest", "model_save", "model_load", "forecast", "model_status"])
def test_forest_queries_answer_on_the_smallest_tables(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    df = registry.entry(spark)
    assert df.columns == ["plant_id", "fecha", "power (kW)"]
    days = [row["fecha"] for row in df.collect()]
    assert days and days == sorted(days)
