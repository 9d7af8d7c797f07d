"""Registered queries, each with the equivalent SQL text where one exists."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tracewell.session import use_utc

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ("aggregates", "windows", "joins", "lookups", "reshaping", "scalars", "sql_surface", "storage", "flows")


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        def add(fn: Query) -> Query:
            def run(spark: SparkSession, folder: str) -> DataFrame:
                use_utc(spark)
                return fn(spark, folder)

            self.queries[name] = run
            if oracle is not None:
                self.oracles[name] = oracle
            return fn

        return add

    def sql(self, name: str, text: str, oracle: str | None = None) -> None:
        """A query that is plain SQL over the tables it names."""

        def run(spark: SparkSession, folder: str) -> DataFrame:
            from tracewell.plans.catalogue.derived import tables_in
            from tracewell.plans.steps import sql_step

            return sql_step(spark, tables_in(spark, folder, text), text, functions=False)

        self.query(name, text if oracle is None else oracle)(run)


def all_queries() -> dict[str, Query]:
    return {k: v for m in MODULES for k, v in import_module(f"{__name__}.{m}").R.queries.items()}


def all_oracles() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"{__name__}.{m}").R.oracles.items()}
