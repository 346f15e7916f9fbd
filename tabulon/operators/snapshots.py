"""Snapshots of whole workbooks and what differs between two of them.

A snapshot is one long relation: sheet, kind, key, text. Values, formulas and styles
have a cell as their key; merges, tables, names, validations, conditional formats and
hidden rows or columns their own. Items are hashed in a tree of sheet, kind and block
of rows: two snapshots are compared by the digests of their blocks, and items only
where these differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .transactions import fingerprint

#: Rows of a sheet in a block; items without a row are dealt by their key.
BLOCK = 1024
# What a style's signature holds, in order.
STYLE = ["bold", "italic", "underline", "size", "name", "color", "pattern", "fill", "left", "right", "top", "bottom", "horizontal", "vertical", "wrap", "number_format", "locked", "hidden"]


def style_signature(style: Column, kinds: dict[str, str]) -> Column:
    """The parts of a style that a fill must not change, with a bar between; ``kinds``: the type of each part, for those that are not texts.

    Null parts are empty, truth values are written True and False, as the reference has them.
    """
    one = lambda c: F.initcap(style[c].cast("string")) if kinds.get(c) == "boolean" else style[c].cast("string")
    return F.concat_ws("|", *[F.coalesce(one(c), F.lit("")) for c in STYLE])


def snapshot(cells: DataFrame, structure: DataFrame | None = None) -> DataFrame:
    """sheet, kind, key, block, text of everything in a workbook.

    ``cells``: sheet, row, col, value (null: none), formula (null: none) and style (a
    signature, null: plain). ``structure``: sheet (null for names of the workbook),
    kind, key, text; its keys tell apart what a sheet may have twice.
    """
    key = F.concat(F.lit("R"), F.col("row").cast("string"), F.lit("C"), F.col("col").cast("string"))
    items = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("text")) for k, c in (("value", "value"), ("formula", "formula"), ("style", "style"))])
    found = cells.select("sheet", key.alias("key"), F.floor(F.col("row") / BLOCK).cast("int").alias("block"), F.inline(items)).where("text is not null")
    out = found.select("sheet", "kind", "key", "block", "text")
    if structure is None:
        return out
    rest = structure.select(F.coalesce("sheet", F.lit("")).alias("sheet"), F.concat(F.lit("structure:"), "kind").alias("kind"), "key", F.pmod(F.crc32(F.col("key").cast("binary")), F.lit(16)).cast("int").alias("block"), F.coalesce("text", F.lit("")).alias("text"))
    return out.unionByName(rest)


def tree(snap: DataFrame) -> DataFrame:
    """sheet, kind, block with fingerprint and n: one digest for each block, whatever the order of its items."""
    return fingerprint(snap, ["sheet", "kind", "block"], F.col("key"), F.col("text"))


def roots(blocks: DataFrame) -> DataFrame:
    """sheet, fingerprint, n: one digest for each sheet out of those of its blocks."""
    digest = fingerprint(blocks, ["sheet"], F.col("kind"), F.col("block").cast("string"), F.col("fingerprint"))
    return digest.drop("n").join(blocks.groupBy("sheet").agg(F.sum("n").alias("n")), "sheet")


def touched(before: DataFrame, after: DataFrame) -> DataFrame:
    """sheet, kind, block of the blocks whose digests (see ``tree``) differ, or that one side has alone."""
    keys = ["sheet", "kind", "block"]
    both = before.select(*keys, F.col("fingerprint").alias("a")).join(after.select(*keys, F.col("fingerprint").alias("b")), keys, "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select(*keys)


def changes(before: DataFrame, after: DataFrame, planned: DataFrame, trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """sheet, kind, key, old, new, change and status of everything that differs, and of every planned cell.

    ``planned``: sheet, row, col of cells whose values were to change. status: changed
    or noop for their values; unexpected for every other difference, formulas and
    styles of planned cells included. ``trees``: the trees of both snapshots where
    they are stored with them; else they are made here. A key that a snapshot holds
    twice counts by its smallest text. Equal snapshots without a plan give no row.
    """
    a, b = trees if trees is not None else (tree(before), tree(after))
    where, keys = touched(a, b), ["sheet", "kind", "key"]
    side = lambda s, c: s.join(where, ["sheet", "kind", "block"], "left_semi").groupBy(*keys).agg(F.min("text").alias(c))
    both = side(before, "old").join(side(after, "new"), keys, "full").where(~F.col("old").eqNullSafe(F.col("new")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    key = F.concat(F.lit("R"), F.col("row").cast("string"), F.lit("C"), F.col("col").cast("string"))
    plan = planned.select("sheet", F.lit("value").alias("kind"), key.alias("key")).distinct().withColumn("plan", F.lit(True))
    out = both.join(plan, keys, "full").withColumn("same", F.col("old").isNull() & F.col("new").isNull())
    status = F.when(F.col("plan"), F.when(F.col("same"), "noop").otherwise("changed")).otherwise("unexpected")
    return out.select(*keys, "old", "new", F.when(~F.col("same"), change).alias("change"), status.alias("status"))


def summary(found: DataFrame) -> DataFrame:
    """status, kind, n of the changes: what a check after a fill looks at first."""
    return found.groupBy("status", "kind").agg(F.count("*").alias("n"))
