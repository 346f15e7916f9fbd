"""Cell addresses: letters, A1 references, spans and how they shift."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_COL, MAX_ROW = 16384, 1048576


def col_to_index(letters: Column) -> Column:
    """'A' is 1, 'XFD' 16384; null for anything that is not letters."""
    value = F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda acc, x: F.when(x == "", acc).otherwise(acc * 26 + F.ascii(x) - 64))
    return F.when(letters.rlike("^[A-Za-z]{1,3}$"), value)


def index_to_col(index: Column) -> Column:
    """Letters of 1 to 16384, else null."""
    i = index.cast("int")
    # bijective base 26: each place takes away what the places before it stand for
    one = F.chr((F.pmod(i - 1, F.lit(26)) + 65).cast("long"))
    rest = F.floor((i - 1) / 26).cast("int")
    two = F.when(rest > 0, F.chr((F.pmod(rest - 1, F.lit(26)) + 65).cast("long"))).otherwise("")
    last = F.floor((rest - 1) / 26).cast("int")
    three = F.when((rest > 0) & (last > 0), F.chr((F.pmod(last - 1, F.lit(26)) + 65).cast("long"))).otherwise("")
    return F.when((i >= 1) & (i <= MAX_COL), F.concat(three, two, one))


def split_a1(ref: Column) -> Column:
    """struct(col, row) of an address like $B$7, however far down its row is, else null."""
    bare, shape = F.replace(ref, F.lit("$"), F.lit("")), "^([A-Za-z]{1,3})([1-9][0-9]*)$"
    row = F.regexp_extract(bare, shape, 2).try_cast("int")
    return F.when(row.isNotNull(), F.struct(col_to_index(F.regexp_extract(bare, shape, 1)).alias("col"), row.alias("row")))


def parse_a1(ref: Column) -> Column:
    """struct(col, row) of an address like $B$7 within the grid's bounds, else null."""
    at = split_a1(ref)
    return F.when((at["col"] <= MAX_COL) & (at["row"] <= MAX_ROW), at)


def shift_point(v: Column, at: Column, n: Column, delete: Column) -> Column:
    """Where row or column ``v`` goes when n are inserted or deleted at ``at``; null if it is deleted."""
    return F.when(v < at, v).when(~delete, v + n).when(v >= at + n, v - n)


def shift_span(a: Column, b: Column, at: Column, n: Column, delete: Column) -> Column:
    """struct(a, b) of an inclusive span after the change: clamped if a part is deleted, null if all of it is."""
    inserted = F.struct(F.when(a >= at, a + n).otherwise(a).alias("a"), F.when(b >= at, b + n).otherwise(b).alias("b"))
    low = F.when(a >= at + n, a - n).when(a >= at, at).otherwise(a)
    high = F.when(b >= at + n, b - n).when(b >= at, at - 1).otherwise(b)
    return F.when(~delete, inserted).when(high >= low, F.struct(low.alias("a"), high.alias("b")))


def r1c1(row: Column, col: Column, abs_row: Column, abs_col: Column, base_row: Column, base_col: Column) -> Column:
    """A reference relative to the cell that holds it: R[-1]C[2], R5C3; R?C? without that cell."""
    one = lambda name, v, fixed, base: F.concat(F.lit(name), F.when(fixed, v.cast("string")).when(base.isNull(), "?").otherwise(F.concat(F.lit("["), (v - base).cast("string"), F.lit("]"))))
    return F.concat(one("R", row, abs_row, base_row), one("C", col, abs_col, base_col))


def interval_similarity(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """100 less the share of the common span by which two intervals' ends lie apart."""
    gap = F.abs(a0 - b0) + F.abs(a1 - b1)
    span = F.greatest(F.greatest(a1, b1) - F.least(a0, b0) + 1, F.lit(1))
    return F.greatest(F.lit(0), 100 - F.floor(100 * gap / span)).cast("int")
