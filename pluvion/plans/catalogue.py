"""Registry of the engine's queries: name -> callable(spark, sf_dir), and the SQL each one must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import DUCKDB, frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "bench_flagship"


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with the SQL that gives the same rows."""

    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def sql_query(name: str, *sources: str):
    """Register a query that a SQL builder gives for both dialects; ``{table}`` in it is a table of the driver."""

    def keep(builder):
        QUERIES[name] = lambda spark, sf_dir: frame(spark, builder, **tables(spark, sf_dir, *sources))
        ORACLES[name] = builder(DUCKDB).format(**{s: s for s in sources})
        return builder

    return keep


def runs(name: str):
    """Give a query of ``sql_query`` another plan; its SQL stays what it must equal."""

    def keep(function):
        if name not in ORACLES:
            raise KeyError(name)
        QUERIES[name] = function
        return function

    return keep


from . import diagnostics, evaluation, inventory, models, nearest, pairs, reports, spatial  # noqa: E402, F401
