"""Every query by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: SQL of queries that need Python on executors (codecs, detectors, sequential rules); those of ORACLE_SQL run without.
PYTHON_SQL: dict[str, str] = {}


def query(sql: str | None = None, python: bool = False) -> Callable:
    """Register a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            (PYTHON_SQL if python else ORACLE_SQL)[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from tracewell.plans import code_queries, corpus_queries, graph_queries, match_queries, provenance_queries, similarity_queries, statistics_queries  # noqa: E402, F401
