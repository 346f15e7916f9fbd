"""Several blocks at once against inserting one after the other."""

import random

import pytest
from pyspark.sql import functions as F

from tabulon.functions.formulas import copy_down
from tabulon.operators import insertions as I
from tabulon.operators import restructure as R

BLOCKS = "sheet string, block int, template_row int, insert_at int, rows_to_add int, c0 int, c1 int"
CELLS = "sheet string, row int, col int, text string"
RANGES = "sheet string, kind string, name string, ref string, type string"


def one_by_one(spark, cells, ranges, blocks):
    """Plain rules, block after block: lowest of a sheet first, sheets by name; shifts and copies by the operators of one insertion."""
    cells, ranges = {(s, r, c): t for s, r, c, t in cells}, list(ranges)
    for sheet, _, template, at, n, c0, c1 in sorted(blocks, key=lambda b: (b[0], -b[3], b[1])):
        if n <= 0:
            continue
        df = spark.createDataFrame([(*k, t) for k, t in cells.items()], CELLS)
        rf = spark.createDataFrame(ranges, RANGES)
        moved, rf = R.apply_shift(df, rf, sheet, "rows", at, n, False)
        cells = {(r.sheet, r.row, r.col): r.text for r in moved.collect()}
        ranges = [(r.sheet, r.kind, r.name, r.ref, r.type) for r in rf.collect()]
        own = [(k[2], t) for k, t in cells.items() if k[0] == sheet and k[1] == template and c0 <= k[2] <= c1]
        made = spark.createDataFrame([(at + o - 1, c, o, t) for o in range(1, n + 1) for c, t in own], "row int, col int, o int, text string")
        text = F.when(F.startswith("text", F.lit("=")), copy_down(F.col("text"), F.col("o")))
        cells |= {(sheet, r.row, r.col): r.t for r in made.select("row", "col", text.alias("t")).collect()}
        last, grown = at + n - 1, []
        for s, kind, name, ref, rule in ranges:
            if s == sheet and kind in ("validation", "conditional_format", "table", "autofilter") and rule not in ("time-of-day",):
                parts = []
                for part in ref.split():
                    (x0, y0), (x1, y1) = [(ord(p[0]) - 64, int(p[1:])) for p in (part.split(":") * 2)[:2]]
                    hit = x1 >= c0 and x0 <= c1 and y0 <= template <= y1 < last if kind in ("validation", "conditional_format") else y1 == template
                    parts.append(f"{chr(64 + x0)}{y0}:{chr(64 + x1)}{last}" if hit else part)
                ref = " ".join(parts)
            grown.append((s, kind, name, ref, rule))
        for s, kind, _, ref, _ in ranges:
            (x0, y0), (x1, y1) = [(ord(p[0]) - 64, int(p[1:])) for p in (ref.split(":") * 2)[:2]] if kind == "merge" else ((0, 0), (0, 1))
            if s == sheet and y0 == y1 == template and x0 >= c0 and x1 <= c1:
                grown += [(sheet, "merge", None, f"{chr(64 + x0)}{r}:{chr(64 + x1)}{r}", None) for r in range(at, at + n)]
        ranges = grown
    return sorted((*k, str(t)) for k, t in cells.items()), sorted(map(str, ranges))


def together(spark, cells, ranges, blocks):
    out, rf = I.expand(spark.createDataFrame(cells, CELLS), spark.createDataFrame(ranges, RANGES), spark.createDataFrame(blocks, BLOCKS))
    return sorted((r.sheet, r.row, r.col, str(r.text)) for r in out.collect()), sorted(str(tuple(r)) for r in rf.select("sheet", "kind", "name", "ref", "type").collect())


CASES = {
    "two blocks": [("S", 1, 4, 5, 2, 1, 3), ("S", 2, 8, 9, 3, 1, 3)],
    "three blocks and another sheet": [("S", 1, 2, 3, 1, 1, 5), ("S", 2, 5, 6, 2, 1, 5), ("S", 3, 9, 10, 1, 1, 5), ("T", 1, 3, 4, 2, 1, 2)],
    "side by side": [("S", 1, 4, 5, 2, 1, 2), ("S", 2, 4, 5, 3, 4, 5)],
    "template above": [("S", 1, 3, 6, 2, 1, 5)],
    "nothing to add": [("S", 1, 3, 4, 0, 1, 5)],
}
SHEETS = [(s, r, c, t) for s in "ST" for r in range(1, 11) for c, t in enumerate([f"=B{r}+$B$4*B${r}+d{r}", f"v{r}", f'=SUM(B{r}:$B$9)&"B{r}"', f"=S!A{r}+T!$A{r}+other!A{r}", None], 1)]
SPANS = [
    ("S", "validation", "v1", "A2:A4", "list"), ("S", "validation", "v2", "A1:B8 D4:E5", "whole"), ("S", "validation", "v3", "B4", "time-of-day"), ("S", "conditional_format", "c1", "A4:E4", "cellIs"), ("S", "conditional_format", "c2", "D3:E3", "expression"),
    ("S", "table", "t1", "A1:C4", None), ("S", "autofilter", "f1", "A1:C8", None), ("S", "merge", "m", "A4:B4", None), ("S", "merge", "m", "B8:D9", None), ("T", "merge", "m", "A3:B3", None), ("T", "validation", "v9", "A3:A20", "list"), ("S", "defined_name", "n1", "S!$A$4:$C$9", None), ("S", "defined_name", "n2", "T!$A$4+S!A5", None),
]


@pytest.mark.parametrize("name", sorted(CASES))
def test_together_is_one_by_one(spark, name):
    assert together(spark, SHEETS, SPANS, CASES[name]) == one_by_one(spark, SHEETS, SPANS, CASES[name])


def test_random_blocks(spark):
    rnd = random.Random(4)
    rows = sorted(rnd.sample(range(2, 10), 4))
    blocks = [("S", i, t, t + 1, rnd.randint(0, 3), 1, rnd.randint(1, 5)) for i, t in enumerate(rows)]
    assert together(spark, SHEETS, SPANS, blocks) == one_by_one(spark, SHEETS, SPANS, blocks)


def test_steps_carry_over_bins(spark):
    b = spark.createDataFrame([("S", 1, 9, 10, 5, 1, 1), ("S", 2, 199_999, 200_000, 7, 1, 1)], BLOCKS)
    rows = spark.createDataFrame([("S", r) for r in (1, 9, 10, 70_000, 199_999, 200_000, 900_000)] + [("U", 10)], "sheet string, row int")
    got = {(r.sheet, r.row): r.by for r in I.shift_of(rows, I.steps(b), F.lower("sheet"), "row", "by").collect()}
    assert got == {("S", 1): 0, ("S", 9): 0, ("S", 10): 5, ("S", 70_000): 5, ("S", 199_999): 5, ("S", 200_000): 12, ("S", 900_000): 12, ("U", 10): None}


def test_one_row_a_range_and_warnings(spark):
    ranges = spark.createDataFrame([("S", "validation", "a", "A1:A5", "list"), ("S", "validation", "b", "A1:A5", "odd"), ("U", "validation", "c", "A1:A5", "odd")], RANGES)
    blocks = spark.createDataFrame([("S", 1, 5, 6, 2, 1, 3), ("S", 2, 9, 10, 4, 1, 3)], BLOCKS)
    got = {r.name: (r.to, r.warning) for r in I.grown_ranges(ranges, blocks).collect()}
    assert got == {"a": ("A1:A7", None), "b": ("A1:A5", "UNSUPPORTED_VALIDATION_PROPAGATION"), "c": ("A1:A5", None)}


def test_no_blocks_no_cells(spark):
    empty = [spark.createDataFrame([], x) for x in (CELLS, RANGES, BLOCKS)]
    out, rf = I.expand(*empty)
    assert out.count() == rf.count() == 0
