"""The registered queries and, where SQL can say it, their reference SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialize, tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that one task is dealt: what it holds in memory does not grow with the table.
ROWS_A_TASK = 1_000_000


def tasks_of(df: DataFrame, least: int, rows: int = ROWS_A_TASK) -> int:
    """Tasks for the rows of a table on files, whose number stands in the files' footers."""
    return max(least, math.ceil(df.count() / rows))


def dealt(df: DataFrame, key: str, rows: int = ROWS_A_TASK) -> DataFrame:
    """The rows dealt out by a key to a task per core, or to more that get ``rows`` rows each.

    For queries that multiply their rows.  The given tables are one row group each, which a
    scan gives to one task; tables of many files need no such shuffle, and the operators
    never do it themselves.
    """
    return df.repartition(tasks_of(df, df.sparkSession.sparkContext.defaultParallelism, rows), key)


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows as the scan deals them where its tasks are many and alike, else ``dealt`` and written.

    How many rows a task reads stands in the files' footers.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    if len(tasks) >= cores and max(tasks) * cores <= 2 * sum(tasks):
        return df
    return materialize(dealt(df, key), "rows")
