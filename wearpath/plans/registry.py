"""Named queries over the standard tables, each with an equivalent SQL text where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

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


def r(column: str | Column, digits: int = 6) -> Column:
    """Rounded double without a negative zero, so two engines agree on the value."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def rs(expression: str, digits: int = 6) -> str:
    """SQL counterpart of `r`."""
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + 0.0)"


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})


def flag(column: str | Column) -> Column:
    """Booleans as 0/1."""
    c = F.col(column) if isinstance(column, str) else column
    return c.cast("int")
