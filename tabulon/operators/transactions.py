"""Lookups, diffs, fingerprints, the ledger and row expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(build: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the last by ``order``; null keys go. Keys are compared as text."""
    best = F.max_by(F.struct(*build.columns), order).alias("x")
    return build.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("lookup_key")).agg(best).select("lookup_key", "x.*")


def lookup(source: DataFrame, key: str, build: DataFrame, result: str, on_missing: str = "block") -> DataFrame:
    """source with ``lookup_value`` and ``lookup_status``: found, or what the policy says of a missing key.

    A null key is skipped. Policies: block, null, skip.
    """
    if on_missing not in ("block", "null", "skip"):
        raise ValueError(f"unknown policy {on_missing}")
    right = build.select("lookup_key", F.coalesce(F.col(result).cast("string"), F.lit("")).alias("lookup_value"), F.lit(True).alias("hit"))
    joined = source.withColumn("lookup_key", F.col(key).cast("string")).join(right, "lookup_key", "left")
    status = F.when(F.col("lookup_key").isNull(), "skipped").when(F.col("hit"), "found").otherwise({"block": "LOOKUP_NOT_FOUND", "null": "null", "skip": "skipped"}[on_missing])
    return joined.withColumn("lookup_status", status).drop("hit", "lookup_key")


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], value: str, planned: DataFrame) -> DataFrame:
    """Keys whose value is new, gone or different, with planned ones apart; a planned cell without a change is a noop."""
    a = before.select(*keys, F.col(value).alias("old"), F.lit(True).alias("in_old"))
    b = after.select(*keys, F.col(value).alias("new"), F.lit(True).alias("in_new"))
    both = a.join(b, keys, "full").join(planned.select(*keys, F.lit(True).alias("plan")), keys, "left")
    same = F.col("old").eqNullSafe(F.col("new")) & F.col("in_old").eqNullSafe(F.col("in_new"))
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").otherwise("changed")
    status = F.when(F.col("plan"), F.when(same, "noop").otherwise("planned")).when(~same, "unexpected")
    return both.withColumn("status", status).where("status is not null").select(*keys, "old", "new", "status", F.when(~same, change).alias("change"))


def fingerprint(df: DataFrame, keys: list[str], *parts: Column) -> DataFrame:
    """Order-free SHA-256 of each group: of its number of rows and two sums over digests of their texts.

    Sums are added up where the rows are, so that a group of any size costs a few numbers.
    """
    digest = F.sha2(F.concat_ws("=", *parts), 256)
    number = lambda a: F.conv(F.substring(digest, a, 15), 16, 10).cast("decimal(38,0)")
    per = df.groupBy(*keys).agg(F.sum(number(1)).alias("a"), F.sum(number(16)).alias("b"), F.count("*").alias("n"))
    return per.select(*keys, F.sha2(F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string"), F.col("n").cast("string")), 256).alias("fingerprint"), "n")


def idempotency(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """What the ledger says of each (plan, region, region_empty): first_run, already_applied, safe_to_reapply or conflict.

    Only committed records are evidence. A null region was never applied, and one not known to be empty is not. Records
    are counted by plan and region first: a plan of any number of regions is never one row.
    """
    per = ledger.where("status = 'committed'").groupBy("plan", "region").agg(F.count("*").alias("n"))
    done = per.groupBy("plan").agg(F.sum("n").alias("n_committed"))
    joined = requests.join(done, "plan", "left").join(per.select("plan", "region", F.lit(True).alias("applied")), ["plan", "region"], "left")
    state = (
        F.when(F.col("n_committed").isNull(), "first_run")
        .when(F.col("applied"), "already_applied")
        .when(F.col("region_empty"), "safe_to_reapply")
        .otherwise("conflict")
    )
    return joined.select("plan", "region", state.alias("decision"), F.coalesce("n_committed", F.lit(0)).alias("n_committed"))


def tail(ledger: DataFrame, order: str, keep: int = 200) -> DataFrame:
    """The newest ``keep`` records: a top-k, not a sort of the whole log."""
    return ledger.orderBy(F.desc(order)).limit(keep)


def expansion(blocks: DataFrame) -> DataFrame:
    """Rows that each block has to grow by, and where they go. ``blocks``: sheet, block, first_row, last_row, planned."""
    existing = F.col("last_row") - F.col("first_row") + 1
    return blocks.withColumn("existing", existing).withColumn("rows_to_add", F.greatest(F.lit(0), F.col("planned") - F.col("existing"))).withColumn("insert_at", F.col("last_row") + 1)


def shifted(blocks: DataFrame) -> DataFrame:
    """expansion() with first and last row after the growth of all blocks above in the same sheet."""
    above = Window.partitionBy("sheet").orderBy("first_row").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("rows_to_add").over(above), F.lit(0))
    grown = expansion(blocks).withColumn("shift", shift)
    return grown.withColumn("new_first", F.col("first_row") + F.col("shift")).withColumn("new_last", F.col("last_row") + F.col("shift") + F.col("rows_to_add"))


def within_ranges(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, on: list[str], width: int = 64) -> DataFrame:
    """Range join: points inside [low, high], equal in ``on``. Both sides are dealt into bins of ``width``, so it stays an equi-join."""
    p = points.withColumn("bin", F.floor(F.col(point) / width))
    r = ranges.withColumn("bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, [*on, "bin"]).where((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("bin")


def as_of(left: DataFrame, right: DataFrame, on: list[str], at: str, tie: list[Column], take: list[str]) -> DataFrame:
    """left with ``take`` of the nearest row of right at or before it: both in one ordered pass, without a join.

    ``tie``: which of several at one place counts, last wins.
    """
    marked = left.withColumn("side", F.lit(1)).withColumn("hit", F.lit(None).cast(right.select(F.struct(at, *take)).schema[0].dataType))
    found = right.select(*on, at, *tie, F.lit(0).alias("side"), F.struct(at, *take).alias("hit"))
    both = marked.unionByName(found, allowMissingColumns=True)
    order = Window.partitionBy(*on).orderBy(at, "side", *tie).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("near", F.last("hit", ignorenulls=True).over(order)).where("side = 1")
    return out.select(*left.columns, F.col(f"near.{at}").alias(f"{at}_found"), *[F.col(f"near.{c}").alias(c) for c in take])
