"""Every registered query of the graph engine against its SQL in DuckDB."""

import duckdb
import pytest

from factloom.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, found):
    """Python values, as pandas turns whole numbers beside nulls into floats on one side only."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str(tuple(row[i] for i in order)) for row in found)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, con, name):
    own, sql = registry.queries()[name](spark, DIR), con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in sql.description]
    assert sorted(own.columns) == sorted(columns)
    assert rows(own.columns, own.collect()) == rows(columns, sql.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    found = e.entry(spark)
    assert found.count() > 0 and "fact_id" in found.columns
    assert set(e.oracle_sql()) <= set(e.queries())
