"""Ordered computations: bands, runs with gaps, repeats and periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, keys: list[str], at: str, gap: int = 0) -> DataFrame:
    """df with ``run``: its number changes where the next position is more than gap + 1 away."""
    order = Window.partitionBy(*keys).orderBy(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(order) > gap + 1).cast("int"), F.lit(0))
    return df.withColumn("new_run", new).withColumn("run", F.sum("new_run").over(order)).drop("new_run")


def bands(df: DataFrame, keys: list[str], at: str, gap: int = 0) -> DataFrame:
    """Start, end, number of positions and of gaps of each run."""
    order = Window.partitionBy(*keys).orderBy(at)
    step = df.withColumn("step", F.col(at) - F.lag(at).over(order))
    out = runs(step, keys, at, gap).groupBy(*keys, "run").agg(
        F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n"), F.count_if((F.col("step") > 1) & (F.col("step") <= gap + 1)).alias("gaps")
    )
    return out.drop("run")


def equal_runs(df: DataFrame, keys: list[str], at: str, value: Column) -> DataFrame:
    """Maximal runs of equal values in order: value, start, end, n."""
    order = Window.partitionBy(*keys).orderBy(at)
    marked = df.withColumn("value", value).withColumn("new", F.coalesce((~F.col("value").eqNullSafe(F.lag("value").over(order))).cast("int"), F.lit(1)))
    return marked.withColumn("run", F.sum("new").over(order)).groupBy(*keys, "run", "value").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n")).drop("run")


def periodic_runs(df: DataFrame, keys: list[str], at: str, value: Column, period: int) -> DataFrame:
    """Stretches in which each value equals the one ``period`` places before: at least two periods, four places, and not constant."""
    order = Window.partitionBy(*keys).orderBy(at)
    marked = df.withColumn("value", value).withColumn("place", F.row_number().over(order))
    marked = marked.withColumn("same", F.col("value").eqNullSafe(F.lag("value", period).over(order)) & (F.col("place") > period))
    marked = marked.withColumn("flat", F.col("value").eqNullSafe(F.lag("value").over(order)) & (F.col("place") > 1))
    islands = marked.where("same").withColumn("island", F.col("place") - F.row_number().over(order))
    found = islands.groupBy(*keys, "island").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count_if("flat").alias("n_flat"), F.count("*").alias("n"))
    span = F.col("last") - F.col("first") + 1 + period
    return found.where((span >= 2 * period) & (span >= 4) & (F.col("n_flat") < F.col("n"))).select(*keys, F.lit(period).alias("period"), (F.col("first") - period).alias("start"), F.col("last").alias("end"))


def step_regularity(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Whether the positions of a group are evenly spaced, and by what."""
    order = Window.partitionBy(*keys).orderBy(at)
    steps = df.withColumn("step", F.col(at) - F.lag(at).over(order)).groupBy(*keys)
    out = steps.agg(F.count("*").alias("n"), F.min("step").alias("lo"), F.max("step").alias("hi"))
    return out.select(*keys, "n", ((F.col("lo") == F.col("hi")) & (F.col("lo") > 0)).alias("regular"), F.when((F.col("lo") == F.col("hi")) & (F.col("lo") > 0), F.col("lo")).alias("step"))
