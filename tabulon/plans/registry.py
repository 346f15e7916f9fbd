"""Where queries and their SQL counterparts are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task where all rows of a key have to meet in one.
DEALT = 100_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` (of ``rows`` rows) by its keys, in as many partitions as hold ``DEALT`` rows each: the larger the table, the more tasks, none of them larger."""
    return df.repartition(max(1, -(-rows // DEALT)), *keys)
