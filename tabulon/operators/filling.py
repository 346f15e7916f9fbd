"""A fill before it happens: validations that cover cells, what each planned cell would get, and what stands against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import truncate_text
from .restructure import range_bounds, range_text
from .transactions import within_ranges

# Kinds of values that fit each other.
# Fixed value: characters of a value that a dry run shows.
PREVIEW = 60
#: Rows of a band, by which the ranges of a sheet are looked up.
BAND = 64
FITTING = ["exact", "numeric_family", "date_family", "blank_tolerant"]
COMPARED = {"greaterThan": lambda x, y: x > y, "lessThan": lambda x, y: x < y, "greaterThanOrEqual": lambda x, y: x >= y, "lessThanOrEqual": lambda x, y: x <= y}


def list_items(formula: Column) -> Column:
    """Items of a literal list like "A, B"; null if the formula is none."""
    text = F.trim(formula)
    items = F.filter(F.transform(F.split(F.substring(text, 2, F.length(text) - 2), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when((F.length(text) >= 2) & F.startswith(text, F.lit('"')) & F.endswith(text, F.lit('"')), items)


def looks_like_reference(formula: Column) -> Column:
    """Whether a validation's formula names a range: nothing that can be checked without it."""
    text = F.regexp_replace(F.trim(F.coalesce(formula, F.lit(""))), '^"+|"+$', "")
    return (text != "") & ~F.startswith(text, F.lit("=")) & (range_bounds(text).isNotNull() | text.contains("!"))


def check_validation(kind: Column, operator: Column, first: Column, second: Column, value: Column) -> Column:
    """ok, invalid or unsupported: literal lists (whatever case), whole and decimal numbers, lengths of texts.

    A comma in a number is a decimal point. Any other rule is unsupported, never guessed.
    """
    number = lambda c: F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")
    text = F.coalesce(value, F.lit(""))
    allowed = F.transform(list_items(first), F.lower)
    x, low, high = number(text), number(first), number(second)
    op = F.coalesce(operator, F.lit("between"))
    both, between = low.isNotNull() & high.isNotNull(), (low <= x) & (x <= high)
    holds = F.when((op == "between") & both, between).when((op == "notBetween") & both, ~between)
    for name, fn in COMPARED.items():
        holds = holds.when((op == name) & low.isNotNull(), fn(x, low))
    said = lambda good: F.when(good, "ok").otherwise("invalid")
    numeric = F.when(x.isNull() | ((kind == "whole") & (x != F.floor(x))), "invalid").when(holds.isNull(), "unsupported").otherwise(said(holds))
    length = F.length(text)
    return (
        F.when(kind == "list", F.when(allowed.isNull(), "unsupported").otherwise(said(F.array_contains(allowed, F.lower(F.trim(text))))))
        .when(kind.isin("whole", "decimal"), numeric)
        .when(kind == "textLength", said(F.coalesce(both & (low <= length) & (length <= high), F.lit(False))))
        .otherwise("unsupported")
    )


def bounded(ranges: DataFrame, ref: str = "ref") -> DataFrame:
    """One row for each range of ``ref`` (separated by spaces) with c0, r0, c1, r1; what is no range goes."""
    b = ranges.withColumn("part", F.explode(F.split(ref, r"\s+"))).withColumn("b", range_bounds(F.col("part"))).where("b is not null")
    return b.select(*ranges.columns, "b.*")


def covering(cells: DataFrame, ranges: DataFrame, keep: list[str], order: str) -> DataFrame:
    """cells (sheet, row, col, ...) with ``hit``: the columns ``keep`` of the first range by ``order`` that covers each, else null.

    An interval join dealt into bins of rows.
    """
    found = within_ranges(cells.select("sheet", "row", "col").distinct(), bounded(ranges), "row", "r0", "r1", ["sheet"]).where("col between c0 and c1")
    first = found.groupBy("sheet", "row", "col").agg(F.min_by(F.struct(*keep), order).alias("hit"))
    return cells.join(first, ["sheet", "row", "col"], "left")


def band(row: Column) -> Column:
    """The band of rows that a row is in."""
    return F.floor(row / BAND)


def by_band(ranges: DataFrame, keep: list[str], order: str, on: list[str], name: str) -> DataFrame:
    """on, band and ``name``: the ranges that reach into each band of rows, for ``first_of``.

    One array for a band, which has at most as many merges as cells. A range without its order is left out.
    """
    r = bounded(ranges).where(F.col(order).isNotNull()).withColumn("band", F.explode(F.sequence(band(F.col("r0")), band(F.col("r1")))))
    return r.groupBy(*on, "band").agg(F.collect_list(F.struct(F.col(order).alias("order"), F.struct(*keep).alias("hit"), "c0", "r0", "c1", "r1")).alias(name))


def first_of(ranges: Column, row: Column, col: Column) -> Column:
    """Of the ranges of a cell's band, what was kept of the first by order that covers it, else null."""
    covers = lambda x: (x["r0"] <= row) & (row <= x["r1"]) & (x["c0"] <= col) & (col <= x["c1"])
    return F.array_min(F.filter(ranges, covers))["hit"]


def validated_columns(validations: DataFrame) -> DataFrame:
    """sheet, col, n: how many validations cover each column."""
    return bounded(validations).select("sheet", F.explode(F.sequence("c0", "c1")).alias("col")).groupBy("sheet", "col").agg(F.count("*").alias("n"))


def slot_rows(slots: DataFrame) -> DataFrame:
    """sheet, col, row of every evidenced slot."""
    rows = bounded(slots).withColumn("col", F.explode(F.sequence("c0", "c1")))
    return rows.select("sheet", "col", F.explode(F.sequence("r0", "r1")).alias("row")).distinct()


def planned_cells(mappings: DataFrame, source: DataFrame) -> DataFrame:
    """One row for each cell that a mapping would touch: mapping's columns, offset, row, value.

    ``mappings``: sheet, col, source_key, mode, anchor_row and what else it carries;
    ``source``: source_key, offset (from 0), value. A scalar takes the first value only.
    A key without rows in the source has one planned cell with a null offset.
    """
    joined = mappings.join(source.select("source_key", "offset", "value"), "source_key", "left").where("mode = 'row_block' or offset is null or offset = 0")
    return joined.withColumn("row", (F.col("anchor_row") + F.coalesce("offset", F.lit(0))).cast("int"))


def dry_run(mappings: DataFrame, source: DataFrame, validations: DataFrame, merges: DataFrame) -> DataFrame:
    """What a fill would do to each planned cell: class (preserved, blocked, would_write), reason and preview; nothing is written.

    In this order: a target that holds formulas is preserved; an empty value blocks a
    required target; then a validation over a value that stays empty, a merge, or kinds
    that do not fit block it, with all reasons. ``reference_rule`` marks cells whose
    validation names a range, which is told and never checked.
    ``mappings`` has target_role, target_kind, required and compatibility.
    """
    cells = planned_cells(mappings, source)
    cells = covering(cells, validations, ["type", "formula1", "n"], "n").withColumnRenamed("hit", "rule")
    cells = covering(cells, merges.withColumn("n", F.monotonically_increasing_id()), ["ref"], "n").withColumnRenamed("hit", "merge")
    empty = F.trim(F.coalesce("value", F.lit(""))) == ""
    preserved = (F.col("target_role") == "formula_derived") | (F.col("target_kind") == "formula")
    failing = F.array_compact(
        F.array(
            F.when(F.col("rule").isNotNull() & empty, "validation target would stay empty"),
            F.when(F.col("merge").isNotNull(), "cell lies inside a merged range"),
            F.when(~F.col("compatibility").isin(FITTING), "value kinds are incompatible"),
        )
    )
    reason = (
        F.when(F.col("anchor_row").isNull(), "no evidenced anchor")
        .when(F.col("offset").isNull(), "source key not present in the source table")
        .when(preserved, "formula-derived target")
        .when(empty & F.coalesce("required", F.lit(False)), "source value is empty for a required target")
        .when(F.size(failing) > 0, F.array_join(failing, "; "))
    )
    missing = F.col("anchor_row").isNull() | F.col("offset").isNull()
    label = F.when(~missing & preserved, "preserved").when(F.col("reason").isNotNull(), "blocked").otherwise("would_write")
    out = cells.withColumn("reason", reason).withColumn("class", label)
    rule = F.coalesce(looks_like_reference(F.col("rule.formula1")), F.lit(False)) & (F.col("class") == "would_write")
    return out.select("sheet", "row", "col", "source_key", "offset", "class", "reason", F.when(~empty, F.left("value", F.lit(PREVIEW))).alias("preview"), rule.alias("reference_rule"))


def expansion_needs(cells: DataFrame, slots: DataFrame) -> DataFrame:
    """sheet, col, planned, available (null if no slot is known), needed: whether a block of rows has to grow."""
    planned = cells.groupBy("sheet", "col").agg(F.count("*").alias("planned"))
    known = slot_rows(slots).groupBy("sheet", "col").agg(F.count("*").alias("available"))
    return planned.join(known, ["sheet", "col"], "left").withColumn("needed", F.col("planned") > F.col("available"))


def planned_region(writes: DataFrame) -> DataFrame:
    """sheet and ref: the smallest range around all planned cells of each sheet."""
    box = writes.groupBy("sheet").agg(F.min("col").alias("c0"), F.min("row").alias("r0"), F.max("col").alias("c1"), F.max("row").alias("r1"))
    return box.select("sheet", range_text(F.col("c0"), F.col("r0"), F.col("c1"), F.col("r1")).alias("ref"))


def empty_regions(writes: DataFrame, cells: DataFrame) -> DataFrame:
    """sheet and empty: whether no planned cell of a sheet holds anything yet."""
    full = cells.where("kind <> 'blank'").select("sheet", "row", "col", F.lit(True).alias("full"))
    return writes.join(full, ["sheet", "row", "col"], "left").groupBy("sheet").agg((F.count("full") == 0).alias("empty"))


def resolve_sources(refs: DataFrame, source: DataFrame) -> DataFrame:
    """refs (ref like Key[3]) with value and resolved: the source's value at that place; unresolved if the key or the place is missing."""
    pattern = r"^(.*)\[([0-9]+)\]$"
    asked = refs.withColumn("source_key", F.regexp_extract("ref", pattern, 1)).withColumn("offset", F.regexp_extract("ref", pattern, 2).try_cast("long"))
    values = source.select("source_key", F.col("offset").cast("long").alias("offset"), "value", F.lit(True).alias("resolved"))
    return asked.join(values, ["source_key", "offset"], "left").withColumn("resolved", F.coalesce("resolved", F.lit(False))).drop("source_key", "offset")


def blockers(found: DataFrame) -> DataFrame:
    """Codes that stand against a fill with how often, most urgent first by name; none means that it may go ahead."""
    return found.groupBy("code").agg(F.count("*").alias("n")).orderBy("code")


def primary_code(codes: Column, priority: list[str]) -> Column:
    """The first of ``priority`` among the codes; else the smallest code."""
    return F.coalesce(F.get(F.filter(F.array(*map(F.lit, priority)), lambda c: F.array_contains(codes, c)), F.lit(0)), F.array_min(codes))


def duplicate_cells(writes: DataFrame) -> DataFrame:
    """Planned cells that more than one mapping writes to."""
    n = F.count("*").over(Window.partitionBy("sheet", "row", "col"))
    return writes.withColumn("n", n).where("n > 1")
