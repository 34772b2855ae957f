"""Queries by name, and the same in SQL written independently of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from sparkloom.operators.records import settled
from sparkloom.sources.shared import dealt

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def projection(name: str, source: str, keys: list[str], columns: Callable[[], dict[str, Column]], sql: dict[str, str], where: str = "", once: Callable[[], dict[str, Column]] | None = None) -> None:
    """A query that adds columns to the keys of a table. The columns are made with the query: they need a session. Those of `once`
    are costly and used more than once: rows are dealt to all cores for them, and they are computed once a row."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        df = df.where(where) if where else df
        df = settled(dealt(df), **once()) if once else df
        return df.select(*keys, *(c.alias(n) for n, c in columns().items()))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT {', '.join(keys)}, {', '.join(f'{s} AS {n}' for n, s in sql.items())} FROM {source}" + (f" WHERE {where}" if where else "")
