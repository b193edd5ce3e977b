"""Registry of named queries: a Spark callable and, where SQL can say the same, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lexanchor.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Decorator that registers ``fn(spark, sf_dir)`` under ``name``."""

        def register(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")

            @wraps(fn)
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                ship_package(spark)
                return fn(spark, sf_dir)

            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return fn

        return register
