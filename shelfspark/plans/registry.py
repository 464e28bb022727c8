"""Registered queries: one Spark job per operator plus its reference-shaped SQL.

Every query reads the driver tables of ``sf_dir`` through ``Library`` so its
work grows with them. The SQL text is what the relational reference would run;
DuckDB executes it as the oracle. Column names and types are aligned with the
Spark result.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import Library
from .oracle import with_views

# Fixed parameters of the registered queries.
AS_OF_LOANS = dt.date(2001, 8, 15)
AS_OF_LOANABLE = dt.date(1998, 6, 15)
AS_OF_REQUESTS = dt.date(2024, 2, 27)

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
LIB_QUERIES: dict[str, Callable[[Library], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[Library], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Library(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        LIB_QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn
    return deco


def load_all() -> None:
    """Import the query modules so their ``register`` calls run."""
    from . import queries_commands, queries_reads, queries_sources, queries_streams  # noqa: F401
