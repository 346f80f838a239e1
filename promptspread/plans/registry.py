"""Query registry: every operator query is a Spark builder plus its DuckDB oracle.

A builder takes ``(spark, sf_dir)`` and returns a DataFrame.  The oracle is
ANSI SQL over the driver tables; derived views are prepended as CTEs.
Queries without an oracle are checked by row counts and pytest references.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from promptspread.functions.stats import round_doubles
from promptspread.sources.views import with_views

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, views: tuple[str, ...] = (), rounded: bool = True):
    """Register ``fn`` under ``name``; doubles are rounded to 6 digits in the result."""

    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return round_doubles(df) if rounded else df

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return fn

    return deco
