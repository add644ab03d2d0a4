"""Named queries and, where SQL can express them, the equivalent SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """A set of queries (spark, sf_dir) -> DataFrame with optional oracle SQL by the same name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        def add(fn: Query) -> Query:
            self.add(name, fn, oracle)
            return fn

        return add

    def add(self, name: str, fn: Query, oracle: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query {name} is registered twice")
        self.queries[name] = fn
        if oracle is not None:
            self.oracles[name] = oracle


#: Queries of the core library.
CORE = Registry()
