"""Rows and columns inserted or deleted: what happens to cells, to references in formulas and to every range of a sheet.

Ranges (merges, validations, conditional formats, tables, filters) are one relation:
sheet, kind, name, ref. Everything is projection by the rules in functions.refs, no cell
is looked up by another. Several blocks of new rows at once: see insertions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formulas import copy_down
from ..functions.refs import col_to_index, index_to_col, shift_point, shift_span

# Kinds of rules that may be stretched over new rows.
STRETCHED = {"validation": ["list", "whole", "decimal", "date", "time", "textLength", "custom"], "conditional_format": ["cellIs", "expression", "colorScale", "dataBar", "iconSet"]}

END = r"(\$?)([A-Za-z]{1,3})(\$?)([0-9]{1,7})"
SHEET = r"('(?:[^']|'')+'!|[A-Za-z_][A-Za-z0-9_.]*!)?"
#: A text in quotes, a reference that is no part of a name, or any one character.
PIECE = rf"\"(?:[^\"]|\"\")*\"|(?<![\w$.:]){SHEET}{END}(?::{END})?(?![\w(])|[\s\S]"
REFERENCE = rf"^{SHEET}{END}(?::{END})?$"


def range_bounds(ref: Column) -> Column:
    """struct(c0, r0, c1, r1) of a range or a single cell, corners in order; null for anything else."""
    pattern = r"^\s*\$?([A-Za-z]{1,3})\$?([0-9]{1,7})(?::\$?([A-Za-z]{1,3})\$?([0-9]{1,7}))?\s*$"
    part = lambda i: F.regexp_extract(ref, pattern, i)
    a, r = col_to_index(part(1)), part(2).try_cast("int")
    b, q = F.coalesce(col_to_index(part(3)), a), F.coalesce(part(4).try_cast("int"), r)
    return F.when(ref.rlike(pattern), F.struct(F.least(a, b).alias("c0"), F.least(r, q).alias("r0"), F.greatest(a, b).alias("c1"), F.greatest(r, q).alias("r1")))


def range_columns(ref: Column) -> Column:
    """struct(first, last) column of a range, else null."""
    b = range_bounds(ref)
    return F.when(b.isNotNull(), F.struct(b["c0"].alias("first"), b["c1"].alias("last")))


def range_text(c0: Column, r0: Column, c1: Column, r1: Column, single: Column | None = None) -> Column:
    """A1 text of a range; ``single``: whether a range of one cell is written as one."""
    a, b = F.concat(index_to_col(c0), r0.cast("string")), F.concat(index_to_col(c1), r1.cast("string"))
    return F.when((a == b) & (single if single is not None else F.lit(False)), a).otherwise(F.concat_ws(":", a, b))


def move_rows(ref: Column, rows: Column) -> Column:
    """A range so many rows further down."""
    b = range_bounds(ref)
    return F.when(b.isNotNull(), range_text(b["c0"], b["r0"] + rows, b["c1"], b["r1"] + rows, ~ref.contains(":")))


def shift_range(ref: Column, axis: str, at: Column, n: Column, delete: Column) -> Column:
    """A range after ``n`` rows or columns are inserted or deleted at ``at``: clamped, or null if all of it is deleted."""
    b = range_bounds(ref)
    lo, hi = ("r0", "r1") if axis == "rows" else ("c0", "c1")
    s = shift_span(b[lo], b[hi], at, n, delete)
    new = dict(c0=b["c0"], r0=b["r0"], c1=b["c1"], r1=b["r1"]) | {lo: s["a"], hi: s["b"]}
    return F.when(s.isNotNull(), range_text(new["c0"], new["r0"], new["c1"], new["r1"], ~ref.contains(":")))


def shift_ranges(refs: Column, axis: str, at: Column, n: Column, delete: Column) -> Column:
    """The same for ranges separated by spaces: those deleted go; null if none is left."""
    left = F.filter(F.transform(F.split(refs, r"\s+"), lambda r: shift_range(r, axis, at, n, delete)), lambda r: r.isNotNull())
    return F.when(F.size(left) > 0, F.array_join(left, " "))


def rewrite_references(text: Column, home: Column, target: Column, axis: str, at: Column, n: Column, delete: Column) -> Column:
    """A formula, or any text with references, after the change of sheet ``target``.

    References without a sheet mean ``home``; sheet names are compared without case.
    Texts in quotes and names that look like references stay. A deleted cell becomes
    #REF!, a range of which a part is deleted is clamped, dollar signs are kept.
    References to the sheet are written with capital letters, whether they move or not.
    """
    # each piece is taken apart once; what follows reads its groups
    group = lambda p, i: p[f"g{i}"]
    apart = lambda p: F.struct(p.alias("p"), p.rlike(REFERENCE).alias("hit"), *[F.regexp_extract(p, REFERENCE, i).alias(f"g{i}") for i in range(1, 10)])

    def end(p: Column, first: int, value: Column, letters=F.upper) -> Column:
        column = letters(group(p, first + 1)) if axis == "rows" else index_to_col(value)
        row = value.cast("string") if axis == "rows" else group(p, first + 3)
        return F.concat(group(p, first), column, group(p, first + 2), row)

    def where(p: Column, first: int) -> Column:
        return group(p, first + 3).try_cast("int") if axis == "rows" else col_to_index(group(p, first + 1))

    def one(p: Column) -> Column:
        name = F.replace(F.regexp_replace(group(p, 1), "^'|'?!$", ""), F.lit("''"), F.lit("'"))
        mine = F.lower(F.when(group(p, 1) == "", home).otherwise(name)) == F.lower(target)
        a, b = where(p, 2), where(p, 6)
        span = shift_span(a, b, at, n, delete)
        # both ends on their own, and together, as they are written, where one of them is deleted
        p0, p1 = shift_point(a, at, n, delete), shift_point(b, at, n, delete)
        clamped = F.concat_ws(":", end(p, 2, span["a"], lambda x: x), end(p, 6, span["b"], lambda x: x))
        pair = F.when(p0.isNotNull() & p1.isNotNull(), F.concat_ws(":", end(p, 2, p0), end(p, 6, p1))).when(span.isNotNull(), clamped)
        new = F.coalesce(F.when(group(p, 7) == "", F.when(p0.isNotNull(), end(p, 2, p0))).otherwise(pair), F.lit("#REF!"))
        return F.when(p["hit"] & mine, F.concat(group(p, 1), new)).otherwise(p["p"])

    return F.array_join(F.transform(F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), apart), one), "")


def apply_shift(cells: DataFrame, ranges: DataFrame, sheet: str, axis: str, at: int, n: int, delete: bool) -> tuple[DataFrame, DataFrame]:
    """(cells, ranges) after ``n`` rows or columns of one sheet are inserted or deleted at ``at``.

    ``cells``: sheet, row, col, text and what else they carry; those deleted go, and the
    formulas of all sheets follow. ``ranges``: sheet, kind, name, ref; ``ref`` becomes what
    it is afterwards, with ``was`` beside it; a range that is deleted has a null ref,
    but for validations and tables, which then stay as they are. Names (kind
    defined_name) are rewritten like formulas, wherever they are.
    """
    where, moved = F.col("row" if axis == "rows" else "col"), "row" if axis == "rows" else "col"
    args = (F.lit(at), F.lit(n), F.lit(delete))
    mine = F.lower("sheet") == sheet.lower()
    new = F.when(mine, shift_point(where, *args)).otherwise(where)
    text = F.when(F.startswith("text", F.lit("=")), rewrite_references(F.col("text"), F.col("sheet"), F.lit(sheet), axis, *args)).otherwise(F.col("text"))
    out = cells.withColumn("text", text).withColumn(moved, new.cast(dict(cells.dtypes)[moved])).where(F.col(moved).isNotNull())
    ref = shift_ranges(F.col("ref"), axis, *args)
    kept = F.when(F.col("kind").isin("validation", "table"), F.coalesce(ref, F.col("ref"))).otherwise(ref)
    name = rewrite_references(F.col("ref"), F.lit(sheet), F.lit(sheet), axis, *args)
    ref = F.when(F.col("kind") == "defined_name", name).when(mine, kept).otherwise(F.col("ref"))
    return out, ranges.withColumn("was", F.col("ref")).withColumn("ref", ref)


# ---------------------------------------------------------------------- new rows


def new_rows(blocks: DataFrame) -> DataFrame:
    """blocks (sheet, block, template_row, insert_at, rows_to_add, c0, c1) with one row for each row to add: at, offset (from 1)."""
    wanted = blocks.where("rows_to_add > 0")
    return wanted.withColumn("offset", F.explode(F.sequence(F.lit(1), F.col("rows_to_add")))).withColumn("at", (F.col("insert_at") + F.col("offset") - 1).cast("int"))


def provision_rows(cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """Cells of the new rows: those of the block's template row with style and all, formulas copied down, values left out."""
    template = cells.withColumnRenamed("row", "template_row")
    out = new_rows(blocks).join(template, ["sheet", "template_row"]).where("col between c0 and c1")
    text = F.when(F.startswith("text", F.lit("=")), copy_down(F.col("text"), F.col("offset")))
    return out.withColumn("text", text).withColumn("row", F.col("at")).select(*cells.columns)
