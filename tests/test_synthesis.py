"""Gated plans of new formulas, their checks after the write, and reasons of refusal: one case or more for each code."""

from pyspark.sql import functions as F

from tabulon.operators import formulas as O
from tabulon.operators import synthesis as Y

from test_formulas import down, entries

TARGETS = "sheet string, row int, col int, family_id string, has_formula boolean"
CELLS = down("=B{r}-$C$1", range(2, 6)) | down("=B{r}-C{r}", range(2, 4), sheet="Short") | down("=INDIRECT(B{r})", range(2, 6), sheet="Late") | down("=MAX(B{r}:B$90)", range(2, 6), sheet="Odd")


def books(spark):
    """Of each sheet one family in column D; Along has one in a row, Two a copied one below which an uncertain one stands."""
    cells = CELLS | {"Along": {f"{c}5": f"={c}3*2" for c in "BCDE"}, "Two": down("=B{r}*2", range(2, 6), sheet="Two")["Two"] | down("=C{r}/3", (12, 13), sheet="Two")["Two"]}
    e = entries(spark, cells)
    return e, Y.with_ids(O.families(O.family_cells(e))[0])


def gates(spark, rows, allowed=None, texts=None):
    e, f = books(spark)
    may = None if allowed is None else spark.createDataFrame(allowed, "sheet string, row int, col int")
    found = Y.plan(spark.createDataFrame(rows, TARGETS), f, e if texts is None else texts(e), may)
    return {(r.sheet, r.row, r.col): (r.blocked, r.formula) for r in found.collect()}


def test_named_families(spark):
    name = lambda s, at=2: f"{s}!vertical:4:{at}"
    rows = [(s, 9, 4, name(s), False) for s in CELLS] + [
        ("Ledger", 10, 4, name("Ledger"), True), ("Ledger", 11, 4, name("Ledger"), None), ("Ledger", 9, 5, name("Ledger"), False), ("Ledger", 12, 4, "gone", False), ("Along", 9, 2, "Along!horizontal:5:2", False), ("Ledger", None, 4, name("Ledger"), False),
    ]
    assert gates(spark, rows) == {
        ("Ledger", 9, 4): (None, "=B9-$C$1"), ("Short", 9, 4): ("FAMILY_CONFIDENCE_BELOW_HIGH", None), ("Late", 9, 4): ("FAMILY_UNSUPPORTED_CONSTRUCT", None), ("Odd", 9, 4): ("WINDOW_PATTERN_NOT_DETERMINISTIC", None),
        ("Ledger", 10, 4): ("TARGET_ALREADY_FORMULA", None), ("Ledger", 11, 4): ("TARGET_STATE_UNKNOWN", None), ("Ledger", 9, 5): ("TARGET_COLUMN_MISMATCH", None), ("Ledger", 12, 4): ("NO_SOURCE_FAMILY", None),
        ("Along", 9, 2): ("TARGET_COLUMN_MISMATCH", None), ("Ledger", None, 4): ("TARGET_STATE_UNKNOWN", None),
    }


def test_nearest_family_that_may_be_copied(spark):
    rows = [(s, 9, 4, None, False) for s in (*CELLS, "Along", "None")] + [("Two", 14, 4, None, False), ("Ledger", 4, 4, None, False), ("Ledger", 5, 4, None, False), ("Ledger", None, None, None, False)]
    assert gates(spark, rows) == {
        ("Ledger", 9, 4): (None, "=B9-$C$1"), ("Two", 14, 4): (None, "=B14*2"), ("Odd", 9, 4): ("WINDOW_PATTERN_NOT_DETERMINISTIC", None), ("Ledger", None, None): ("TARGET_STATE_UNKNOWN", None),
        # families that may not be copied, of rows, or that end below or in the target's own row
        **{(s, r, 4): ("NO_SOURCE_FAMILY", None) for s, r in (("Short", 9), ("Late", 9), ("Along", 9), ("None", 9), ("Ledger", 4), ("Ledger", 5))},
    }


def test_what_may_be_written_and_read(spark):
    rows = [("Ledger", r, 4, None, False) for r in (8, 9)]
    assert gates(spark, rows, [("Ledger", 8, 4), ("Ledger", 8, 4)]) == {("Ledger", 8, 4): (None, "=B8-$C$1"), ("Ledger", 9, 4): ("TARGET_NOT_ALLOWED", None)}
    assert {b for b, _ in gates(spark, rows, []).values()} == {"TARGET_NOT_ALLOWED"}
    assert {b for b, _ in gates(spark, rows, texts=lambda e: e.where("false")).values()} == {"SOURCE_TEXT_UNAVAILABLE"}
    assert {b for b, _ in gates(spark, rows, texts=lambda e: e.withColumn("text", F.lit("=B2+$C$1"))).values()} == {"REFERENCE_TRANSLATION_MISMATCH"}
    # copied above the sheet's first row, a reference breaks
    up = gates(spark, [("Two", 1, 4, "Two!vertical:4:12", False)], texts=lambda e: e)
    assert up == {("Two", 1, 4): ("FAMILY_CONFIDENCE_BELOW_HIGH", None)}
    assert gates(spark, []) == {}


def test_checks_after_the_write(spark):
    e, f = books(spark)
    plan = Y.plan(spark.createDataFrame([("Ledger", r, 4, None, False) for r in (7, 8, 9)] + [("Short", 9, 4, None, False)], TARGETS), f, e)
    before = e.select("sheet", "row", "col", "text")
    new = lambda *texts: spark.createDataFrame([("Ledger", r, 4, t) for r, t in texts], "sheet string, row int, col int, text string")
    state = lambda after: {(r.sheet, r.check): (r.expected, r.found, r.passed) for r in Y.verified(plan, before, after).collect()}
    good = state(before.unionByName(new((7, "=B7-$C$1"), (8, "=B8-$C$1"), (9, "=B9-$C$1"))))
    assert all(passed for _, _, passed in good.values()) and {s for s, _ in good} == {"Ledger", "Short"} and len(good) == 16
    assert {good["Ledger", c][0] for c in ("formula_count_delta", "formula_exists", "sheets_preserved")} == {3}
    # one as planned, one with another reference, one without the anchor; an old formula changed, another sheet's gone
    hurt = before.where("sheet <> 'Odd'").withColumn("text", F.when((F.col("sheet") == "Ledger") & (F.col("row") == 3), "=B3").otherwise(F.col("text")))
    bad = state(hurt.unionByName(new((7, "=B7-$C$1"), (8, "=B9-$C$1"), (9, "=B9-C1"))))
    assert {c: bad["Ledger", c] for c in ("formula_count_delta", "formula_exists", "syntax_preserved", "signature_matched", "offsets_matched", "absolute_preserved", "sheets_preserved", "unrelated_changed")} == {
        "formula_count_delta": (3, 3, True), "formula_exists": (3, 3, True), "syntax_preserved": (3, 1, False), "signature_matched": (3, 1, False), "offsets_matched": (3, 1, False),
        "absolute_preserved": (3, 2, False), "sheets_preserved": (3, 3, True), "unrelated_changed": (0, 1, False),
    }
    assert bad["Odd", "unrelated_changed"] == (0, 4, False) and bad["Odd", "formula_count_delta"] == (0, -4, False)
    none = state(before)
    assert none["Ledger", "formula_exists"] == (3, 0, False) and none["Ledger", "unrelated_changed"] == (0, 0, True)


def test_reasons(spark):
    cases = {
        "=SUM(A1:A9)": [], "=[Book.xlsx]Data!A1": ["external workbook reference", "structured or external reference", "structured reference"], "={1,2}": ["array or constant formula"],
        "=_XLFN.SORT(A1)": ["future function (_xlfn)"], "=#REF!+A1": ["broken reference (#REF!)"], "= -A1": ["formula without a leading reference is not a supported copy-down pattern"],
        '="[x] {y} #REF!"&A1': [], "plain": [], "{x}": ["array or constant formula"], "": [],
    }
    df = spark.createDataFrame([(t, []) for t in cases] + [(None, []), ("=FILTER(A:A,B:B)+SORT(A:A)", ["FILTER", "SORT"]), ("=OFFSET(A1,1,0)", ["OFFSET"]), ("=RTD(A1)", ["RTD"])], "text string, functions array<string>")
    got = {r.text: r.why for r in df.select("text", Y.unsupported_reasons(F.col("text"), F.col("functions")).alias("why")).collect()}
    assert got == cases | {None: [], "=FILTER(A:A,B:B)+SORT(A:A)": ["dynamic array function: FILTER,SORT"], "=OFFSET(A1,1,0)": ["late-bound function: OFFSET"], "=RTD(A1)": []}
