"""Named queries of this subpackage, each with SQL text where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]
BUILDERS: dict[str, Builder] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def register(build: Builder) -> Builder:
        if name in BUILDERS:
            raise ValueError(f"query {name} is registered twice")
        BUILDERS[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register
