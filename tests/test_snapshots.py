"""Snapshots: every kind of difference by hand, and blocks that are alike are passed over."""

import pytest
from pyspark.sql import functions as F

from tabulon.operators import snapshots as S

CELLS = "sheet string, row int, col int, value string, formula string, style string"
PARTS = "sheet string, kind string, key string, text string"


def snap(spark, cells, parts=()):
    return S.snapshot(spark.createDataFrame(cells, CELLS), spark.createDataFrame(list(parts), PARTS))


BEFORE = [("S", 1, 1, "a", None, "p"), ("S", 2, 1, "b", None, None), ("S", 5000, 1, "far", None, None), ("S", 3, 2, "7", "=A1", "p"), ("T", 1, 1, "t", None, None)]
PARTS_BEFORE = [("S", "merge", "A1:B1", None), ("S", "table", "t1", "A1:C9"), (None, "defined_name", "n", "S!A1"), ("S", "hidden", "rows", "3,4"), ("S", "validation", "A1:A9|list", "x"), ("S", "conditional_format", "B1|cellIs", "y")]


def diff(spark, after, parts=PARTS_BEFORE, planned=()):
    plan = spark.createDataFrame(list(planned), "sheet string, row int, col int")
    got = S.changes(snap(spark, BEFORE, PARTS_BEFORE), snap(spark, after, parts), plan)
    return sorted((r.sheet, r.kind, r.key, r.old, r.new, r.change, r.status) for r in got.collect())


def replaced(i, **new):
    names = ["sheet", "row", "col", "value", "formula", "style"]
    return [tuple((dict(zip(names, c, strict=True)) | new).values()) if k == i else c for k, c in enumerate(BEFORE)]


def test_nothing_differs(spark):
    assert diff(spark, list(reversed(BEFORE)), list(reversed(PARTS_BEFORE))) == []
    assert S.changes(snap(spark, []), snap(spark, []), spark.createDataFrame([], "sheet string, row int, col int")).collect() == []


@pytest.mark.parametrize(
    "after, want",
    [
        (replaced(0, value="z"), ("S", "value", "R1C1", "a", "z", "changed", "unexpected")),
        (replaced(3, formula="=A2"), ("S", "formula", "R3C2", "=A1", "=A2", "changed", "unexpected")),
        (replaced(0, style="q"), ("S", "style", "R1C1", "p", "q", "changed", "unexpected")),
        (BEFORE[:1] + BEFORE[2:], ("S", "value", "R2C1", "b", None, "removed", "unexpected")),
        ([*BEFORE, ("U", 9, 9, "new", None, None)], ("U", "value", "R9C9", None, "new", "added", "unexpected")),
    ],
)
def test_cells(spark, after, want):
    assert diff(spark, after) == [want]


@pytest.mark.parametrize("i", range(len(PARTS_BEFORE)))
def test_structure_of_every_kind(spark, i):
    sheet, kind, key, text = PARTS_BEFORE[i]
    gone = diff(spark, BEFORE, PARTS_BEFORE[:i] + PARTS_BEFORE[i + 1 :])
    assert gone == [(sheet or "", f"structure:{kind}", key, text or "", None, "removed", "unexpected")]


def test_planned_cells_apart(spark):
    planned = [("S", 1, 1), ("S", 2, 1), ("S", 9, 9)]
    after = [("S", 1, 1, "z", "=B1", "q"), *BEFORE[1:]]
    assert diff(spark, after, planned=planned) == [
        ("S", "formula", "R1C1", None, "=B1", "added", "unexpected"), ("S", "style", "R1C1", "p", "q", "changed", "unexpected"), ("S", "value", "R1C1", "a", "z", "changed", "changed"),
        ("S", "value", "R2C1", None, None, None, "noop"), ("S", "value", "R9C9", None, None, None, "noop"),
    ]


def test_only_blocks_that_differ_are_compared(spark):
    a, b = snap(spark, BEFORE), snap(spark, replaced(2, value="else"))
    ta, tb = S.tree(a), S.tree(b)
    assert [tuple(r) for r in S.touched(ta, tb).collect()] == [("S", "value", 5000 // S.BLOCK)]
    ra, rb = ({r.sheet: (r.fingerprint, r.n) for r in S.roots(t).collect()} for t in (ta, tb))
    assert ra["T"] == rb["T"] and ra["S"][0] != rb["S"][0] and ra["S"][1] == rb["S"][1] == 7


def test_style_signature(spark):
    style = F.struct(*[F.lit({"bold": True, "size": 11, "wrap": False}.get(c)).alias(c) for c in S.STYLE])
    assert spark.range(1).select(S.style_signature(style, {"bold": "boolean", "wrap": "boolean"})).first()[0] == "True|||11|||||||||||False|||"
