"""Changed sheets, planned fills, evidence and matching on small cases, one or more for each rule."""

import pytest
from pyspark.sql import functions as F

from tabulon.operators import filling as L
from tabulon.operators import matching as M
from tabulon.operators import insertions as I
from tabulon.operators import restructure as R
from tabulon.operators import semantics as K


def value(spark, expression):
    return spark.range(1).select(expression).first()[0]


@pytest.mark.parametrize(
    "ref, want",
    [("B3:D9", (2, 3, 4, 9)), ("$D$9:$B$3", (2, 3, 4, 9)), ("C7", (3, 7, 3, 7)), (" a1:A2 ", (1, 1, 1, 2)), ("A:C", None), ("", None), (None, None), ("XFDA1", None)],
)
def test_bounds_of_ranges(spark, ref, want):
    got = value(spark, R.range_bounds(F.lit(ref).cast("string")))
    assert (got and tuple(got)) == want


@pytest.mark.parametrize(
    "ref, axis, at, n, delete, want",
    [
        ("B3:D9", "rows", 3, 2, False, "B5:D11"), ("B3:D9", "rows", 5, 2, False, "B3:D11"), ("B3:D9", "rows", 10, 2, False, "B3:D9"), ("B3:D9", "rows", 4, 2, True, "B3:D7"), ("B3:D9", "rows", 1, 4, True, "B1:D5"),
        ("B3:D9", "rows", 2, 20, True, None), ("B3:D9", "cols", 3, 1, True, "B3:C9"), ("B3:D9", "cols", 2, 1, False, "C3:E9"), ("C7", "rows", 7, 1, False, "C8"), ("C7", "rows", 7, 1, True, None), ("C7:C7", "rows", 1, 1, False, "C8:C8"),
    ],
)
def test_shifted_ranges(spark, ref, axis, at, n, delete, want):
    assert value(spark, R.shift_range(F.lit(ref), axis, F.lit(at), F.lit(n), F.lit(delete))) == want


@pytest.mark.parametrize(
    "text, axis, delete, want",
    [
        ("=A9+$B$11", "rows", False, "=A9+$B$13"), ("=a10+b1", "rows", False, "=A12+B1"), ("=SUM(c8:c14)", "rows", True, "=SUM(C8:C12)"), ("=SUM(c10:c14)", "rows", True, "=SUM(c10:c12)"), ("=A9+$B$10", "rows", True, "=A9+#REF!"), ("=SUM(C8:C$14)", "rows", True, "=SUM(C8:C$12)"), ("=SUM(C10:C11)", "rows", True, "=SUM(#REF!)"), ("=SUM(C11:C14)", "rows", True, "=SUM(C10:C12)"),
        ('="A12"&A12', "rows", False, '="A12"&A14'), ("=Own!A12+own!A12+Other!A12", "rows", False, "=Own!A14+own!A14+Other!A12"), ("='It''s'!A12", "rows", False, "='It''s'!A12"), ("=LOG10(A12)+TAXES2024", "rows", False, "=LOG10(A14)+TAXES2024"),
        ("=J1+K1+L$1", "cols", True, "=#REF!+#REF!+J$1"), ("=I1+J1", "cols", False, "=I1+L1"), ("=A:A+12:12", "rows", False, "=A:A+12:12"), ("=A12.5", "rows", False, "=A14.5"), ('="say ""A12"""', "rows", False, '="say ""A12"""'),
    ],
)
def test_rewritten_references(spark, text, axis, delete, want):
    assert value(spark, R.rewrite_references(F.lit(text), F.lit("Own"), F.lit("OWN"), axis, F.lit(10), F.lit(2), F.lit(delete))) == want


def test_a_sheet_is_shifted_with_all_that_refers_to_it(spark):
    cells = spark.createDataFrame([("S", 1, 1, "=A3"), ("S", 2, 1, "gone"), ("S", 3, 1, "7"), ("T", 2, 1, "=S!A3+A3"), ("T", 3, 1, None)], "sheet string, row int, col int, text string")
    ranges = spark.createDataFrame([("S", "merge", "", "A2:B2"), ("S", "validation", "", "A2:A2"), ("S", "validation", "", "A2 B3:B9"), ("T", "merge", "", "A2:B2"), (None, "defined_name", "n", "S!$A$3")], "sheet string, kind string, name string, ref string")
    c, r = R.apply_shift(cells, ranges, "s", "rows", 2, 1, True)
    assert sorted(map(tuple, c.collect()), key=str) == sorted([("S", 1, 1, "=A2"), ("S", 2, 1, "7"), ("T", 2, 1, "=S!A2+A3"), ("T", 3, 1, None)], key=str)
    assert [(x.was, x.ref) for x in r.collect()] == [("A2:B2", None), ("A2:A2", "A2:A2"), ("A2 B3:B9", "B2:B8"), ("A2:B2", "A2:B2"), ("S!$A$3", "S!$A$2")]


def test_new_rows(spark):
    blocks = spark.createDataFrame([("S", "b", 5, 6, 2, 1, 3), ("T", "b", 5, 6, 0, 1, 3)], "sheet string, block string, template_row int, insert_at int, rows_to_add int, c0 int, c1 int")
    cells = spark.createDataFrame([("S", 5, 1, "x", "bold"), ("S", 5, 2, "=A5*$B$1", ""), ("S", 5, 4, "out", ""), ("S", 4, 1, "above", ""), ("T", 5, 1, "no", "")], "sheet string, row int, col int, text string, style string")
    assert sorted(map(tuple, R.provision_rows(cells, blocks).collect())) == [("S", 6, 1, None, "bold"), ("S", 6, 2, "=A6*$B$1", ""), ("S", 7, 1, None, "bold"), ("S", 7, 2, "=A7*$B$1", "")]
    merges = spark.createDataFrame([("S", "A5:B5"), ("S", "A4:B5"), ("S", "C5:D5"), ("T", "A5:B5")], "sheet string, ref string")
    blocks = blocks.withColumn("block", F.lit(1))
    assert sorted(r.ref for r in I.new_merges(merges, blocks).collect()) == ["A6:B6", "A7:B7"]
    ranges = [("validation", "A1:A5 F1:F5", "list"), ("validation", "A1:A5", "other"), ("conditional_format", "B5:B5", "cellIs expression"), ("conditional_format", "B5:B5", "top10"), ("table", "A1:C5", ""), ("table", "A1:C4", ""), ("merge", "A1:C5", ""), ("validation", "A1:A9", "list")]
    got = I.grown_ranges(spark.createDataFrame([("S", k, "", r, t) for k, r, t in ranges], "sheet string, kind string, name string, ref string, type string"), blocks)
    assert {(r.kind, r.ref, r.type, r.to, r.warning) for r in got.collect()} == {
        ("validation", "A1:A5 F1:F5", "list", "A1:A7 F1:F5", None), ("validation", "A1:A5", "other", "A1:A5", "UNSUPPORTED_VALIDATION_PROPAGATION"), ("conditional_format", "B5:B5", "cellIs expression", "B5:B7", None),
        ("conditional_format", "B5:B5", "top10", "B5:B5", "PRESERVE_WITH_WARNING"), ("table", "A1:C5", "", "A1:C7", None), ("table", "A1:C4", "", "A1:C4", None), ("merge", "A1:C5", "", "A1:C5", None), ("validation", "A1:A9", "list", "A1:A11", None),
    }


@pytest.mark.parametrize(
    "rule, text, want",
    [
        (("list", None, '"GRS, Ocs"', None), " grs ", "ok"), (("list", None, '"GRS,OCS"', None), "RWS", "invalid"), (("list", None, "Codes!A1:A9", None), "GRS", "unsupported"), (("whole", None, "1", "9"), "4", "ok"), (("whole", None, "1", "9"), "4.5", "invalid"),
        (("whole", None, "1", "9"), "x", "invalid"), (("decimal", "notBetween", "1", "9"), "9,5", "ok"), (("decimal", "lessThan", "3", None), "3", "invalid"), (("decimal", "equal", "3", None), "3", "unsupported"), (("textLength", None, "1", "3"), "abcd", "invalid"),
        (("textLength", None, "0", "3"), None, "ok"), (("textLength", None, "x", "3"), "ab", "invalid"), (("custom", None, "=A1", None), "1", "unsupported"),
    ],
)
def test_validation_rules(spark, rule, text, want):
    assert value(spark, L.check_validation(*[F.lit(x).cast("string") for x in (*rule, text)])) == want


def test_dry_run(spark):
    mappings = [("S", "A", 1, "row_block", 2, "label", "string", False, "exact"), ("S", "B", 2, "row_block", 2, "flag", "string", True, "exact"), ("S", "A", 3, "scalar", 9, "formula_derived", "integer", True, "mismatch"), ("S", "Z", 4, "row_block", 2, "label", "string", False, "exact"), ("S", "A", 5, "scalar", None, "label", "string", False, "exact"), ("S", "A", 6, "scalar", 3, "label", "string", False, "mismatch")]
    m = spark.createDataFrame(mappings, "sheet string, source_key string, col int, mode string, anchor_row int, target_role string, target_kind string, required boolean, compatibility string")
    source = spark.createDataFrame([("A", 0, "one"), ("A", 1, None), ("B", 0, "x"), ("B", 1, " ")], "source_key string, offset long, value string")
    rules = spark.createDataFrame([("S", "A1:A9", "list", "Codes!A1", 1), ("S", "A1:A9", "whole", "1", 2)], "sheet string, ref string, type string, formula1 string, n int")
    merges = spark.createDataFrame([("S", "B2:C2"), ("S", "F3:F4")], "sheet string, ref string")
    got = {(r.row, r.col): (r["class"], r.reason, r.reference_rule) for r in L.dry_run(m, source, rules, merges).collect()}
    assert got == {
        (2, 1): ("would_write", None, True), (3, 1): ("blocked", "validation target would stay empty", False), (2, 2): ("blocked", "cell lies inside a merged range", False), (3, 2): ("blocked", "source value is empty for a required target", False),
        (9, 3): ("preserved", "formula-derived target", False), (2, 4): ("blocked", "source key not present in the source table", False), (None, 5): ("blocked", "no evidenced anchor", False), (3, 6): ("blocked", "cell lies inside a merged range; value kinds are incompatible", False),
    }


def test_fill_helpers(spark):
    writes = spark.createDataFrame([("S", 3, 2), ("S", 9, 4), ("T", 1, 1)], "sheet string, row int, col int")
    assert {tuple(r) for r in L.planned_region(writes).collect()} == {("S", "B3:D9"), ("T", "A1:A1")}
    cells = spark.createDataFrame([("S", 9, 4, "string"), ("T", 1, 1, "blank")], "sheet string, row int, col int, kind string")
    assert {tuple(r) for r in L.empty_regions(writes, cells).collect()} == {("S", False), ("T", True)}
    refs = spark.createDataFrame([("A[0]",), ("A[5]",), ("A",), ("X[0]",)], "ref string")
    source = spark.createDataFrame([("A", 0, "v")], "source_key string, offset int, value string")
    assert {(r.ref, r.value, r.resolved) for r in L.resolve_sources(refs, source).collect()} == {("A[0]", "v", True), ("A[5]", None, False), ("A", None, False), ("X[0]", None, False)}
    rules = spark.createDataFrame([("S", "A1:C2 B9"), ("S", "bad")], "sheet string, ref string")
    assert {tuple(r) for r in L.validated_columns(rules).collect()} == {("S", 1, 1), ("S", 2, 2), ("S", 3, 1)}
    slots = spark.createDataFrame([("S", "A2:B3")], "sheet string, ref string")
    needs = spark.createDataFrame([("S", 1)] * 3 + [("S", 2), ("S", 5)], "sheet string, col int")
    assert {(r.col, r.planned, r.available, r.needed) for r in L.expansion_needs(needs, slots).collect()} == {(1, 3, 2, True), (2, 1, 2, False), (5, 1, None, None)}
    assert value(spark, L.primary_code(F.array(F.lit("B"), F.lit("A")), ["X", "B"])) == "B" and value(spark, L.primary_code(F.array(F.lit("B"), F.lit("A")), ["X"])) == "A"
    assert L.duplicate_cells(writes.union(writes.limit(1))).count() == 2
    assert [tuple(r) for r in L.blockers(spark.createDataFrame([("B",), ("A",), ("B",)], "code string")).collect()] == [("A", 1), ("B", 2)]


def test_evidence_of_every_kind(spark):
    columns = [(1, "fatura tarihi", "date", 9, 9, "dd.mm.yyyy", 0.0, None, False, False), (2, "oran %", "decimal", 9, 3, "0.00%", 0.0, None, False, False), (3, "bedel ₺", "decimal", 9, 9, '#,##0.00 "d"', 0.6, None, False, False), (4, "kalan|2024", "integer", 9, 9, None, 0.0, "input_region", True, True)]
    df = spark.createDataFrame([("S", *c) for c in columns], "sheet string, col int, norm string, type string, n_cells long, n_distinct long, number_format string, formula_share double, region string, in_input_region boolean, validated boolean")
    terms = K.dictionary(spark, {"currency": ["bedel"], "date": ["tarih"]})
    got = {(r.col, r.role, r.weight) for r in K.evidence(df, terms).collect()}
    assert {(1, "date", 25), (2, "percent", 20), (2, "percent", 25), (3, "currency", 25), (3, "formula_derived", 36), (4, "empty_slot", 25), (4, "identifier", 10), (4, "quantity", 15), (4, "quantity", 20)} <= got
    assert not {(3, "date", 25), (1, "percent", 25)} & got
    assert K.dictionary_conflicts(spark, {"a": ["x", "y"], "b": ["y"]}).collect()[0] == ("y", "a", "b")
    assert value(spark, K.value_kind(F.lit("integer"), F.lit(0.5))) == "formula"
    proposal = spark.createDataFrame([("summary", None, True, "string"), ("label", "input_region", False, "mixed"), ("label", None, False, "mixed")], "role string, region string, inside boolean, kind string").select(K.required(F.col("role"), F.col("region"), F.col("inside"), F.col("kind")).alias("r")).collect()
    assert [(r.r.required, r.r.reasons) for r in proposal] == [(False, ["role:summary is derived, not filled"]), (True, ["region:input_region"]), (True, ["no positive evidence"])]


def test_labels_slots_and_material_columns(spark):
    c = spark.createDataFrame([("S", 1, "label", "h", 3, None, None, "string"), ("S", 2, "empty_slot", None, 0, None, "General", "blank"), ("S", 3, "unknown", "", 0, "", None, None)], "sheet string, col int, role string, header string, n_cells int, region string, number_format string, type string")
    assert [r[0] for r in c.orderBy("col").select(K.is_material(c)).collect()] == [True, False, False]
    r = K.label_report(c).first()
    assert (r.n_columns, r.n_labelled, r.coverage, r.roles) == (3, 2, 66, "empty_slot:1,label:1,unknown:1")
    regions = spark.createDataFrame([("S", "input_region", "A1:B2"), ("S", "data", "A3:B9")], "sheet string, type string, ref string")
    assert {tuple(x) for x in K.slots(regions, c).collect()} == {("S", "input_slot", "A1:B2", None), ("S", "input_slot_column", None, 2)}


def test_matched_regions_and_sheets(spark):
    schema = "pair string, region int, type string, first_row int, last_row int"
    t = spark.createDataFrame([("p", 1, "data", 1, 10), ("p", 2, "data", 20, 30), ("p", 3, "notes", 40, 41)], schema)
    i = spark.createDataFrame([("p", 7, "data", 21, 30), ("p", 8, "data", 1, 9), ("p", 9, "total", 40, 41)], schema)
    assert {(r.t_region, r.i_region, r.score) for r in M.match_regions(t, i).collect()} == {(1, 8, 90), (2, 7, 90), (3, -1, -1)} or {(r.t_region, r.i_region) for r in M.match_regions(t, i).collect()} == {(1, 8), (2, 7), (3, None)}
    layout = "pair string, merges array<string>, tables array<string>, validations array<string>, freeze string, filter string, hidden string"
    a = spark.createDataFrame([("p", ["A1:B1", "C1:D1"], [], ["A1"], "A2", None, None), ("q", [], [], [], None, None, None)], layout)
    b = spark.createDataFrame([("p", ["A1:B1"], [], [], "A3", None, None), ("q", [], [], [], None, None, None)], layout)
    assert {tuple(r) for r in M.structural_score(a, b).collect()} == {("p", (50 + 100 + 50 + 60 + 100 + 100) // 6), ("q", 100)}
    assert value(spark, M.sheet_score(*[F.lit(float(x)) for x in (100, 50, 50, 100)])) == 78
    report = spark.createDataFrame([("region", "A1", True), ("region", "A1", True), ("column", "B", False)], "kind string, subject string, requires_review boolean")
    assert [r.subject for r in M.review_subjects(report).collect()] == ["region|A1"]
    pair = "pair string, col int, norm string, role string, type string, number_format string"
    left = spark.createDataFrame([("p", 1, "", "label", None, "0"), ("p", 2, "x", None, "string", None)], pair)
    right = spark.createDataFrame([("p", 1, "", "label", None, "0.0"), ("p", 2, "x", None, "string", None)], pair)
    assert {(r.t_col, r.i_col): r.score for r in M.pair_scores(left, right).collect()} == {(1, 1): 30, (1, 2): 0, (2, 1): 0, (2, 2): 80}
