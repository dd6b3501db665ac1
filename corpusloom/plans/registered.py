"""The registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df over all cores by its keys where it comes from fewer files than there are cores (a file of one row group is one task), else as it is.

    For rows that cost far more than an exchange; a large table has files enough and isn't moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if len(df.inputFiles()) < cores else df  # a number given isn't undone by adaptive execution


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over all cores by its keys, whatever its size: for rows of a few bytes that packages are made of, which would else stay in the one task that their bytes fill.

    Grouping by the same keys goes after it, not before: an exchange by keys that rows are grouped by already is dropped, and their own is shrunk to a task."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
