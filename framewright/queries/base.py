"""Registry of queries: a Spark callable per key and, where SQL can say it, the same in SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(column, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def spread_files(df: DataFrame, key: str) -> DataFrame:
    """Rows that become a file each, dealt out over several tasks a core; rows of one key, so of one name, stay together."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, key)


def spread_scan(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """Give every core rows of a small scan before a pixel stage; a scan of enough splits stays as it is.

    With `rows` no task gets much more than so many, however large the splits: where a row costs milliseconds, a split of
    the usual size would be one long task.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if rows:
        wanted = max(wanted, math.ceil(df.count() / rows))
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, key)
