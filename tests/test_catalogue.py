"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables; what its plan must not have."""

import re

import duckdb
import pandas as pd
import pytest

from sparkloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canon(df):
    cols = sorted(df.columns)
    cell = lambda x: "-" if x is None or x is pd.NA or x != x else f"{x:.9g}" if isinstance(x, float) else str(x)
    return cols, sorted(tuple(cell(x) for x in row) for row in df[cols].astype(object).itertuples(index=False))


#: Queries that read files through a Python data source.
PYTHON = {"template_files", "captured_source"}


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_against_sql(spark, duck, name):
    """The same rows, by a plan without products of tables and without Python."""
    got = catalogue.QUERIES[name](spark, SF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert name in PYTHON or not re.search(r"Python|Pandas|InArrow", plan)
    assert canon(got.toPandas()) == canon(duck.sql(catalogue.ORACLE_SQL[name]).df())


def test_entry_point_without_session():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_plans(spark):
    plan = catalogue.flagship(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "CartesianProduct" not in plan
