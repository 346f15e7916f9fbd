import pytest
from pyspark.sql import functions as F

from tabulon.functions.infer import infer_csv, infer_source, rollup_type
from tabulon.functions.refs import col_to_index, index_to_col, parse_a1, shift_span, split_a1
from tabulon.functions.text import is_section, looks_like_notes, normalize_header, summary_label, truncate_text
from tabulon.plans import QUERIES


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize("text, kind, value", [
    (None, "blank", None), ("  ", "blank", None), ("Evet", "boolean", "true"), ("no", "boolean", "false"), ("+12", "integer", "12"), ("1 250", "integer", "1250"), ("1250,50", "decimal", "1250.50"),
    ("1.250,50", "decimal", "1250.50"), ("1,250.50", "decimal", "1250.50"), ("1,234", "decimal", "1.234"), ("01.02.2026", "date", "01.02.2026"), ("2026-02-01 10:00", "date", "2026-02-01 10:00"),
    ("1e5", "string", "1e5"), (".5", "string", ".5"), ("12,5%", "string", "12,5%"),
])
def test_infer_source(spark, text, kind, value):
    got = one(spark, infer_source, text)
    assert (got["kind"], got["value"]) == (kind, value)


@pytest.mark.parametrize("text, kind", [
    ("", "blank"), ("=A1", "formula"), ("TRUE", "boolean"), ("1_000", "integer"), (" 12 ", "integer"), ("1e3", "decimal"), ("nan", "decimal"), ("-inf", "decimal"), ("2026-01-31", "date"),
    ("2026-01-31T10:00", "datetime"), ("1250,50", "string"), ("2026-13-01", "string"),
])
def test_infer_csv(spark, text, kind):
    assert one(spark, infer_csv, text) == kind


@pytest.mark.parametrize("kinds, want", [
    (["integer", "decimal"], "decimal"), (["date"], "datetime"), (["date", "datetime", "blank"], "datetime"), (["integer", "blank"], "integer"), (["formula"], "formula"), ([], "blank"), (["string", "integer"], "mixed"),
])
def test_rollup(spark, kinds, want):
    assert one(spark, rollup_type, kinds, "array<string>") == want


@pytest.mark.parametrize("text, want", [
    ("  Birim   Fiyat: ", "birim fiyat"), ("İSTANBUL", "istanbul"), ("Order_Date", "order date"), ("*Total*", "total"), (None, None), ("Straße", "strasse"), ("A B", "a b"), ("é", "é"),
])
def test_normalize_header(spark, text, want):
    assert one(spark, normalize_header, text) == want


def test_labels(spark):
    assert one(spark, summary_label, "ara toplam 2") == "subtotal"
    assert one(spark, summary_label, "grand total 2025") == "total"
    assert one(spark, summary_label, "name") is None
    assert one(spark, looks_like_notes, "not: x") and not one(spark, looks_like_notes, "not")
    assert one(spark, lambda c: is_section(c, F.lit(False)), "GELIRLER") and not one(spark, lambda c: is_section(c, F.lit(False)), "A1B2")
    assert len(one(spark, truncate_text, "x" * 61)) == 60 and one(spark, truncate_text, "x" * 60) == "x" * 60


@pytest.mark.parametrize("i, letters", [(1, "A"), (26, "Z"), (27, "AA"), (52, "AZ"), (53, "BA"), (702, "ZZ"), (703, "AAA"), (16384, "XFD")])
def test_columns(spark, i, letters):
    assert one(spark, index_to_col, i, "int") == letters and one(spark, col_to_index, letters) == i


def test_bounds(spark):
    assert one(spark, index_to_col, 16385, "int") is None and one(spark, col_to_index, "A1") is None
    assert one(spark, parse_a1, "XFE1") is None and one(spark, parse_a1, "A0") is None and one(spark, parse_a1, "$B$7") == (2, 7)
    span = lambda a, b: one(spark, lambda c: shift_span(F.lit(a), F.lit(b), c, F.lit(2), F.lit(True)), 3, "int")
    assert span(3, 4) is None and span(2, 5) == (2, 3) and span(5, 6) == (3, 4) and span(1, 3) == (1, 2)


def test_addresses_below_the_grid(spark):
    assert one(spark, parse_a1, "A1048577") is None and one(spark, parse_a1, "A1048576") == (1, 1048576)
    assert one(spark, split_a1, "$A$1048577") == (1, 1048577) and one(spark, split_a1, "B54000000") == (2, 54000000)
    assert one(spark, split_a1, "A99999999999") is None and one(spark, split_a1, "A0") is None and one(spark, split_a1, "7") is None


def test_round_trip_of_rows_below_the_grid(spark, tmp_path):
    spark.createDataFrame([(3, 7), (9_000_000, 16383)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["a1_roundtrip"](spark, str(tmp_path)).select("o_orderkey", "ref", "col_back", "row_back").collect()
    assert sorted(map(tuple, got)) == [(3, "H4", 8, 4), (9_000_000, "XFD9000001", 16384, 9_000_001)]
