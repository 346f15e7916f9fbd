"""The match report and the rules of formats and dictionaries, a case for each."""

import json

import pytest
from pyspark.sql import functions as F

from tabulon.operators import assembly as A
from tabulon.operators import report as R
from tabulon.operators import semantics as K

SHEETS = "match string, sheet string, pos int, kinds map<string,long>, merges array<string>, tables array<string>, validations array<string>, freeze string, filter string, hidden string"
COLUMNS = "match string, sheet string, col int, norm string, role string, type string, number_format string"
REGIONS = "match string, sheet string, region int, type string, first_row int, last_row int"


def book(spark, sheets, columns, regions=()):
    rows = [("m", s, n, k, ["A1:B1"], [], [], None, None, "") for n, (s, k) in enumerate(sheets)]
    return {"sheets": spark.createDataFrame(rows, SHEETS), "columns": spark.createDataFrame([("m", *c) for c in columns], COLUMNS), "regions": spark.createDataFrame([("m", *r) for r in regions], REGIONS)}


@pytest.fixture(scope="module")
def report(spark):
    t = book(
        spark,
        [("Data", {"sum": 2}), ("Prices", {}), ("Alone", {}), ("Empty", {})],
        [("Data", 1, "id", "identifier", "integer", None), ("Data", 2, "name", "label", "string", None), ("Data", 3, "gone", "x", "date", "d"), ("Prices", 1, "price", "currency", "decimal", "0.00"), ("Prices", 2, "unit", "code", "string", None), ("Alone", 1, "nothing like it", "y", "string", None)],
        [("Data", 0, "header", 1, 1), ("Data", 1, "body", 2, 90), ("Data", 2, "totals", 91, 91)],
    )
    i = book(
        spark,
        [("Other", {}), ("Data", {"sum": 1, "ratio": 1}), ("More", {})],
        [("Data", 1, "id", "identifier", "string", None), ("Data", 2, "name", "label", "string", "@"), ("Data", 4, "new", "free_text", "boolean", "z"), ("Other", 1, "price", "currency", "decimal", "0.00"), ("Other", 2, "code", "code", "string", None), ("More", 1, "zz", None, "blank", None)],
        [("Data", 0, "header", 1, 2), ("Data", 1, "body", 3, 95), ("Data", 2, "body", 100, 110)],
    )
    return R.match_report(t, i)


def test_sheets_by_name_then_by_headers(report):
    got = {r.t_sheet: r for r in report.sheets.collect()}
    assert {k: (r.i_sheet, r.how) for k, r in got.items()} == {"Data": ("Data", "name"), "Prices": ("Other", "headers"), "Alone": (None, None), "Empty": (None, None)}
    # two of three columns and regions; one formula in four differs either way; all parts of the layout alike
    data = got["Data"]
    assert (data.column_score, data.region_score, data.formula_score, data.structural_score) == (66, 66, 50, 100) and data.pair_score == 70
    assert got["Alone"].pair_score == 0 and got["Alone"].pair_level == "LOW" and got["Alone"].requires_review
    assert [(r.overall_score, r.n_sheets, r.n_unmatched) for r in report.overall.collect()] == [(round(sum(r.pair_score for r in got.values()) / 4), 4, 2)]


def test_columns_and_regions(report):
    got = {(r.t_sheet, r.t_col): (r.i_col, r.score, r.reason) for r in report.columns.collect()}
    assert got["Data", 1] == (1, 93, None) and got["Data", 2] == (2, 97, None) and got["Prices", 1][:2] == (1, 100)
    assert got["Data", 3] == (None, None, "no instance column reached the minimum match score 30")
    regions = {(r.t_sheet, r.t_region): (r.i_region, r.reason) for r in report.regions.collect()}
    assert regions == {("Data", 0): (0, None), ("Data", 1): (1, None), ("Data", 2): (None, "no instance region of this type")}


def test_leftovers_and_conflicts(report):
    assert {(r.i_sheet, r.kind, r.number) for r in report.extras.collect()} == {("Data", "column", 4), ("Data", "region", 2), ("More", "sheet", None)}
    got = {(r.t_sheet, r.t_col, r.kind, r.template, r.instance) for r in report.conflicts.collect()}
    assert got == {("Data", 1, "value_kind", "integer", "string"), ("Data", 2, "number_format", None, "@")}


def test_nothing_to_match(spark):
    none = book(spark, [], [])
    r = R.match_report(none, none)
    assert [df.count() for df in (r.sheets, r.columns, r.regions, r.extras, r.conflicts, r.overall)] == [0] * 6


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "fmt, date, currency, percent, shows",
    [
        ("yyyy-mm-dd;#", True, False, False, False), ("h:mm", False, False, False, True), ("mm", False, False, False, False), ("ss", False, False, False, True), ("#,##0.00 GBP", False, True, False, False), ("0.0%", False, False, True, False),
        ("dd.mm.yyyy", True, False, False, True), ("m/d", True, False, False, True), ('0 "day"', False, False, False, False), ("£0", False, True, False, False), (None, False, False, False, False), ("DD/MM", True, False, False, True), ('[Red]0 \\d', False, False, False, False),
    ],
)
def test_format_rules(spark, fmt, date, currency, percent, shows):
    f = F.lit(fmt).cast("string")
    assert tuple(one(spark, K.format_hints(f))) == (percent, currency, date) and one(spark, A.shows_dates(f)) == shows


def test_units(spark):
    guess = lambda norm, kind, fmt, units=None: one(spark, K.unit_guess(F.lit(norm), F.lit(kind), F.lit(fmt).cast("string"), units))
    assert guess("tutar/kg", "decimal", None, {"kg": "kg"}) == "kg" and guess("kg", "string", None, {"kg": "kg"}) is None
    assert guess("x", "string", "0 TRY", {}) == "₺" and guess("x", "string", "0%", {}) == "%" and guess("kg", "decimal", "€0", {"kg": "kg"}) == "kg" and guess("x", "integer", "0", {}) is None


def test_rules_of_a_file(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text(json.dumps({"dictionary_version": "1", "roles": {"date": ["tarih"]}, "units": {"kg": ["KG", "kilo"], "t": ["ton", "kilo"]}, "keywords": {"note_words": ["bemerkung"]}}))
    terms, units, keywords = K.load_rules(spark, str(path))
    assert [tuple(r) for r in terms.collect()] == [("tarih", "date")] and units == {"kg": "kg", "kilo": "kg", "ton": "t"}
    assert keywords["note_words"] == ["bemerkung"] and keywords["id_words"] == K.KEYWORDS["id_words"]
    path.write_text(json.dumps({"keywords": {"odd": []}}))
    with pytest.raises(ValueError):
        K.load_rules(spark, str(path))


def test_locale_patterns(spark):
    formats = spark.createDataFrame([(f,) for f in ["0", "0", "dd.mm", "0.0", None, ""] + [f"0{i}" for i in range(6)] + ["0", "hh"]], "number_format string")
    got = [(r.format, r.n, r.is_date) for r in A.locale_patterns(formats).orderBy("rank").collect()]
    assert got[0] == ("0", 3, False) and len([g for g in got if not g[2]]) == 5 and ("dd.mm", 1, True) in got and ("hh", 1, True) in got
