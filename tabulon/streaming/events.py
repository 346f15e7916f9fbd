"""Streams of events and of the operation ledger. Each function takes a batch or a stream and gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "1 hour"


def _stamped(df: DataFrame, at: str) -> DataFrame:
    """Structured Streaming wants instants; wall-clock times are read in the session's zone."""
    return df.withColumn(at, F.col(at).cast("timestamp"))


def tumbling(df: DataFrame, at: str, keys: list[str], width: str, value: str, slide: str | None = None, late: str = LATE) -> DataFrame:
    """Counts and sums over windows of time; rows later than ``late`` behind the newest are left out of a stream."""
    rows = _stamped(df, at)
    rows = rows.withWatermark(at, late) if df.isStreaming else rows
    out = rows.groupBy(F.window(at, width, slide or width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def sessions(df: DataFrame, at: str, keys: list[str], gap: str, late: str = LATE) -> DataFrame:
    """Bursts of activity that end after a pause of ``gap``."""
    rows = _stamped(df, at)
    rows = rows.withWatermark(at, late) if df.isStreaming else rows
    out = rows.groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def once(df: DataFrame, at: str, keys: list[str], late: str = LATE) -> DataFrame:
    """The first of re-delivered rows: state is kept for as long as rows may still be late."""
    if df.isStreaming:
        return _stamped(df, at).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
    first = F.min_by(F.struct(*df.columns), at).alias("x")
    return df.groupBy(*keys).agg(first).select("x.*")


def ledger_updates(df: DataFrame, sink_path: str, checkpoint: str):
    """Append new ledger rows of a stream to a table; a batch that is repeated after a failure is written once."""
    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink_path}/batch={number}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
