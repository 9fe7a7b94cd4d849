"""Core queries: name -> (Spark plan, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kestrel.operators import changes
from kestrel.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("p3_found", changes.CHANGED_SQL)
def p3_found(spark, d):
    return changes.changed_paths(table(spark, d, "file_scans"), table(spark, d, "index_runs"))


@query("p3_counts", changes.COUNTS_SQL)
def p3_counts(spark, d):
    return changes.change_counts(table(spark, d, "file_scans"), table(spark, d, "index_runs"))
