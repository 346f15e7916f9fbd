"""Formula reading, families, windows, intents, graph and synthesis on cases of our own, one or more for each rule."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulon.functions.formulas import intent, intent_confidence, parse, translate
from tabulon.operators import formulas as O


def place(ref):
    letters, row = re.match("([A-Z]+)([0-9]+)", ref).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(row), col


def entries(spark, cells: dict):
    rows = [(sheet, *place(ref), text) for sheet, own in cells.items() for ref, text in own.items()]
    return O.parsed(spark.createDataFrame(rows, "sheet string, row int, col int, text string"))


def down(template, rows, col="D", odd=None, sheet="Ledger"):
    """One column of formulas; ``odd``: other texts at some rows."""
    return {sheet: {f"{col}{r}": (odd or {}).get(r, template.format(r=r, p=r - 1, n=r + 1)) for r in rows}}


def along(template, letters, row=7, sheet="Ledger"):
    return {sheet: {f"{c}{row}": template.format(c=c, d=chr(ord(c) + 1)) for c in letters}}


def found(spark, cells):
    f, assigned = O.families(O.family_cells(entries(spark, cells)))
    return f.collect(), assigned.collect()


@pytest.mark.parametrize(
    "cells, confidence, singles, outliers",
    [
        (down("=B{r}-C{r}", [3]), [], 1, 0),
        (down("=B{r}-C{r}", [3, 4]), ["MEDIUM"], 0, 0),
        (down("=B{r}-C{r}", range(3, 9)), ["HIGH"], 0, 0),
        (down("=B{r}-C{r}", [3, 4, 6, 7]), ["MEDIUM"], 0, 0),  # a gap between members
        (down("=B{r}-C{r}", [3, 4, 5, 6], odd={6: "=B6/C6"}), ["HIGH"], 0, 1),
        (down("=B{r}-C{r}", [3, 4, 5, 7], odd={7: "=B7/C7"}), ["MEDIUM"], 0, 1),  # members without a gap, but the run has one
        (down("=B{r}-C{r}", [3, 5]), ["LOW"], 0, 0),
        (down("=B{r}-C{r}", [3, 4, 20, 21, 22]), ["HIGH", "MEDIUM"], 0, 0),
        (down("=B{r}-C{r}", [3, 4, 5, 6], odd={4: "=B4", 5: "=C5*2", 6: "=9"}), [], 4, 0),
        (along("={c}2+{c}3", "DEFG"), ["HIGH"], 0, 0),
        (down("=B{r}-C{r}", [3, 4, 5]) | down("=B{r}-C{r}", [3, 4], sheet="Other"), ["HIGH", "MEDIUM"], 0, 0),
    ],
)
def test_families(spark, cells, confidence, singles, outliers):
    f, cells_ = found(spark, cells)
    assert sorted(r.confidence for r in f) == confidence
    assert (sum(r.state == "single" for r in cells_), sum(r.state == "outlier" for r in cells_)) == (singles, outliers)


@pytest.mark.parametrize(
    "cells, window",
    [
        (down("=B{r}-C{r}", range(2, 6)), "single_cell"),
        (down("=MAX($B$2:$B$40)", range(2, 6)), "fixed"),
        (down("=MAX(B$2:B{r})", range(3, 6)), "expanding"),
        (down("=MAX(B$2:B{r})+C{r}", range(3, 6)), "expanding"),  # a cell beside a range says nothing
        (down("=MAX(B{p}:B{n})", range(3, 6)), "rolling"),
        (down("=MAX(B{r}:B$90)", range(3, 6)), "UNKNOWN_WINDOW"),  # contracting
        (down("=MAX(A{r}:C{r})", range(3, 6)), "single_row"),
        (down("=MAX($A$1:C{r})", range(1, 5)), "UNKNOWN_WINDOW"),  # one row in the first member only
        (down("=MAX(B$2:B{r})-MIN(C{p}:C{r})", range(3, 6)), "UNKNOWN_WINDOW"),
        (down("=MAX(B:B)", range(3, 6)), "whole_column"),
        (down("=MAX(4:4)", range(13, 16), odd={r: f"=MAX({r - 9}:{r - 9})" for r in range(13, 16)}), "whole_row"),
        (down("=MAX(Prices!B$2:B$9)", range(3, 6)), "cross_sheet_fixed"),
        (down("=MAX(Prices!B2:D2)", range(3, 6), odd={r: f"=MAX(Prices!B{r}:D{r})" for r in range(3, 6)}), "cross_sheet_fixed"),
        (down("=MAX(Prices!B{r}:B{n})", range(3, 6)), "cross_sheet_relative"),
        (down("=MAX(Prices!B:B)", range(3, 6)), "cross_sheet_relative"),
        (down("=MAX(LEDGER!B{r}:B{n})", range(3, 6)), "rolling"),  # its own sheet
        (down("=MAX(B{p}:B{n})", range(3, 5)), "UNKNOWN_WINDOW"),  # two members
        (down("=MAX(B{p}:B{n})", [3, 4, 6]), "UNKNOWN_WINDOW"),  # uneven steps
        (along("=MAX($A2:{c}3)", "DEF"), "expanding"),
        (along("=MAX({c}2:{d}3)", "DEF"), "rolling"),
        (along("=MAX($A2:{c}2)", "DEF"), "single_row"),
        (along("=MAX({c}2:{c}5)", "DEF"), "rolling"),
    ],
)
def test_windows(spark, cells, window):
    f, _ = found(spark, cells)
    assert [r.window for r in f] == [window]


@pytest.mark.parametrize(
    "text, want, confidence",
    [
        ("=B2-C2", "calculation", "HIGH"), ("=1+1", "calculation", "HIGH"), ("=-B2", "unknown", "LOW"), ("=MIN(B:B)", "aggregation", "HIGH"), ("=MAX(D1:D7)", "summary", "MEDIUM"), ("=MAX(C1:C7)", "aggregation", "HIGH"),
        ("=Prices!B2", "reference", "HIGH"), ("=B2/C2", "ratio", "MEDIUM"), ("=B2/C2*100", "percentage", "MEDIUM"), ("=B2+NOW()", "date_logic", "MEDIUM"),
        ('=IF(MAX(B2:B9)>3,"a","b")', "conditional", "MEDIUM"), ('=IF(B2>3,"a","b")', "conditional", "HIGH"), ('=IF(B2,"a","b")', "unknown", "LOW"), ("=IFERROR(VLOOKUP(B2,F:G,2),0)", "unknown", "LOW"),
        ("=HLOOKUP(B2,3:4,2)", "lookup", "HIGH"), ("=INDEX(B:B,MATCH(C2,C:C,0))", "lookup", "HIGH"), ("=ISTEXT(B2)", "validation_logic", "MEDIUM"), ("=LEN(B2)>5", "validation_logic", "MEDIUM"), ('="B2-C2"', "unknown", "LOW"),
    ],
)
def test_intent(spark, text, want, confidence):
    e = entries(spark, {"S": {"D8": text}}).withColumn("i", intent(F.col("p")))
    assert tuple(e.select("i", intent_confidence(F.col("p"), F.col("i"))).first()) == (want, confidence)


def test_families_agree_on_an_intent(spark):
    f, _ = found(spark, down("=MAX(D$1:D{p})", range(3, 6)))
    assert [r.intent for r in f] == ["summary"]


def test_parse_odd_texts():
    assert parse("plain")["signature"] == ""
    assert parse(None)["refs"] == []
    assert parse("=[2]Books!C4", 1, 3)["unsupported"] == ["UNSUPPORTED_EXTERNAL_REFERENCE"]
    assert parse("=Sales[Net]")["unsupported"] == ["UNSUPPORTED_STRUCTURED_FORMULA"]
    assert parse("=#REF!-2")["unsupported"] == ["UNSUPPORTED_BROKEN_REFERENCE"]
    assert parse("=WEIGHT*COUNT_")["names"] == ["COUNT_", "WEIGHT"]
    assert parse('="B7"&C3', 3, 4)["signature"] == '"B7"&R[0]C[-1]'
    assert translate('=B4*$D$1+"B4"&C$2', 5) == '=B9*$D$1+"B4"&C$2'
    assert translate("=B2", -3) == "=#REF!"


def test_edges(spark):
    e = O.edges(entries(spark, {"S": {"B1": "=C1", "B2": "=C2", "B3": "=C3", "D9": "=SUM(B1:B3)", "E9": "=SUM(A1:B2)", "F9": "=[1]Books!C4"}}))
    got = {(r.source, r.target, r.kind) for r in e.collect()}
    assert {t for s, t, k in got if k == "range" and s == "S!R9C4"} == {"S!R1C2", "S!R2C2", "S!R3C2"}
    assert {t for s, t, k in got if k == "range" and s == "S!R9C5"} == {"S!R1C2", "S!R2C2"}
    assert ("S!R9C4", "S!B1:B3", "range_node") in got and ("S!R1C2", "S!R1C3", "point") in got and not any(s == "S!R9C6" for s, _, _ in got)
    few = O.edges(entries(spark, {"S": {f"B{i}": f"=C{i}" for i in range(1, 9)} | {"D9": "=SUM(B3:B8)", "E9": "=SUM(A3:B8)"}}), most=2)
    assert {(r.source, r.target) for r in few.where("kind = 'range'").collect()} == {(s, t) for s in ("S!R9C4", "S!R9C5") for t in ("S!R3C2", "S!R4C2")}


def test_canonical_cycle(spark):
    df = spark.createDataFrame([(["c", "a", "b"],), (["a"],), ([],)], "n array<string>")
    assert [r[0] for r in df.select(O.canonical_cycle(F.col("n"))).collect()] == [["a", "b", "c"], ["a"], []]


def test_target_states(spark):
    cells = spark.createDataFrame([("S", 1, 1, "formula"), ("S", 2, 1, "integer"), ("S", 3, 1, "blank")], "sheet string, row int, col int, kind string")
    targets = spark.createDataFrame([("S", r, 1) for r in (1, 2, 3, 4)] + [("none", 1, 1)], "sheet string, row int, col int")
    got = sorted((r.sheet, r.row, r.has_formula, r.has_value) for r in O.target_states(targets, cells).collect())
    assert got == [("S", 1, True, True), ("S", 2, False, True), ("S", 3, False, False), ("S", 4, False, False), ("none", 1, False, False)]


def test_repeated_formulas_are_read_once(spark):
    from tabulon.functions import formulas as M

    M._known.cache_clear()
    texts = [f"=SUM(A{r}:A{r + 1})" for r in (1, 2)] * 50 + [None, "x"]
    got = M._parse.func(*map(pa.array, (texts, [5] * 102, [2] * 102))).to_pylist()
    assert M._known.cache_info().misses == 4
    assert [g["signature"] for g in got] == [M.parse(t, 5, 2)["signature"] for t in texts]
    assert got[99] == got[1] and got[0]["refs"][0]["r0"] == 1 and got[1]["refs"][0]["r0"] == 2
