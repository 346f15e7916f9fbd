"""Maps and profiles: the reference's canonical JSON, whatever the order of rows."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tabulon.operators import maps as M
from tabulon.sources import saved

FACTS = {
    "sheets": ("pos int, visibility string, used_range string, freeze string, filter string", [("B", "T", 1, "hidden", None, None, "A1:C9"), ("B", "S", 0, "visible", "A1:B9", "A2", None), ("C", "S", 0, "visible", None, None, None)]),
    "regions": ("type string, ref string, first_row int, last_row int", [("B", "S", "data", "A2:B9", 2, 9), ("B", "S", "header", "A1:B1", 1, 1)]),
    "headers": ("row int, col int, norm string", [("B", "S", 1, 2, "adı \"x\""), ("B", "S", 1, 1, "no")]),
    "columns": ("col int, header string, norm string, type string, number_format string, role string", [("B", "S", 2, 'Adı "x"', 'adı "x"', "string", None, "label"), ("B", "S", 1, "No", "no", "integer", "0", "identifier")]),
    "parts": ("kind string, name string, ref string", [("B", "S", "table", "t2", "A1:B9"), ("B", "S", "table", "t1", "D1:E2"), ("B", "S", "merge", None, "A5:B5"), ("B", "S", "hidden_row", None, "10"), ("B", "S", "hidden_row", None, "9"), ("B", "S", "validation", "list", "A2:A9"), ("B", "S", "conditional_format", "cellIs", "B2"), ("B", "S", "hidden_column", None, "3"), ("B", "S", "defined_name", "zed", None), ("B", "S", "defined_name", "abc", None)]),
    "formulas": ("kind string, n long", [("B", "S", "function", 2), ("B", "S", "direct_sum", 1)]),
    "repeated": ("type string, signature string, occurrences int, rows int, first_row int", [("B", "S", "record", "a|b", 4, 2, 2)]),
}


def facts(spark, turn=False, rows=True):
    return {k: spark.createDataFrame((list(reversed(r)) if turn else r) if rows else [], f"book string, sheet string, {s}") for k, (s, r) in FACTS.items()}


@pytest.fixture(scope="module")
def found(spark):
    return {r.book: r for r in M.document_maps(facts(spark), "d1").collect()}


def canonical(x):
    return json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


SHORT = {
    "name": "S", "visibility": "visible", "used_range": "A1:B9", "regions": [["header", "A1:B1"], ["data", "A2:B9"]], "headers": [[["A", "no"], ["B", 'adı "x"']]], "columns": [["A", "no", "integer", "0"], ["B", 'adı "x"', "string", None]],
    "tables": [["t1", "D1:E2"], ["t2", "A1:B9"]], "merged_cells": ["A5:B5"], "hidden_rows": [9, 10], "hidden_columns": [3], "freeze_panes": "A2", "autofilter": None, "validations": [["A2:A9", "list"]], "conditional_formats": [["B2", "cellIs"]],
    "formula_summary": {"kinds": {"direct_sum": 1, "function": 2}, "total": 3}, "repeated_structures": [["record", "a|b", 4, 2]],
}
BARE = {"name": "T", "visibility": "hidden", "used_range": None, "freeze_panes": None, "autofilter": "A1:C9", "formula_summary": {"kinds": {}, "total": 0}} | {k: [] for k, v in SHORT.items() if isinstance(v, list)}


def test_content_identity_is_of_canonical_json(found):
    want = canonical({"doc_map_schema": "1", "dictionary_version": "d1", "defined_names": ["abc", "zed"], "sheets": [SHORT, BARE]})
    assert found["B"].content_identity == hashlib.sha256(want.encode()).hexdigest()
    known = {"content_identity": found["B"].content_identity, "structure_fingerprint": found["B"].structure_fingerprint, "profile_version": "1", "dictionary_version": "d1"}
    assert found["B"].profile_id == hashlib.sha256(canonical(known).encode()).hexdigest()


def test_documents_are_canonical_and_whole(found):
    for r in found.values():
        for text in (r.map, r.profile):
            assert canonical(json.loads(text)) == text
    doc, profile = json.loads(found["B"].map), json.loads(found["B"].profile)
    assert [s["name"] for s in doc["sheets"]] == ["S", "T"] and doc["workbook"]["sheet_count"] == 2 and doc["workbook"]["defined_names"] == ["abc", "zed"]
    assert profile["sheets"][0]["columns"][1] == {"letter": "B", "header": 'Adı "x"', "normalized_header": 'adı "x"', "data_type": "string", "number_format": None, "semantic_role": "label", "value_kind": "string"}
    assert json.loads(found["C"].map)["sheets"][0]["columns"] == []


def test_order_of_rows_makes_no_difference(spark, found):
    again = {r.book: r for r in M.document_maps({k: df.repartition(3) for k, df in facts(spark, turn=True).items()}, "d1").collect()}
    assert again == found
    other = {r.book: r for r in M.document_maps(facts(spark), "d2").collect()}
    assert other["B"].content_identity != found["B"].content_identity and other["B"].structure_fingerprint == found["B"].structure_fingerprint


def test_saved_and_read_back(spark, found, tmp_path):
    for name, r in found.items():
        (tmp_path / f"{name}.map").write_text(r.map)
        (tmp_path / f"{name}.profile").write_text(r.profile)
    for what in ("map", "profile"):
        docs = saved.read_saved(spark, str(tmp_path / f"*.{what}"))
        assert docs.count() == 2 and saved.problems(docs, what).count() == 0


def test_nothing(spark):
    assert M.document_maps(facts(spark, rows=False), "d").collect() == []


def test_plan_identity(spark):
    plans = spark.createDataFrame([("p", "x", 1), ("q", "x", 1), ("r", "y", None)], "plan string, profile string, n int")
    cells = [("S", "A2", "src[0]", "write"), ("S", "A1", "src[1]", "write")]
    entries = spark.createDataFrame([(p, *c) for p, own in (("p", cells), ("q", cells[::-1])) for c in own], "plan string, sheet string, cell string, source string, write_policy string")
    got = {r.plan: r.plan_id for r in M.plan_identity(plans, entries, ["profile", "n"]).collect()}
    want = canonical({"entries": [["S", "A1", "src[1]", "write"], ["S", "A2", "src[0]", "write"]], "profile": "x", "n": 1})
    assert got["p"] == got["q"] == hashlib.sha256(want.encode()).hexdigest() and got["r"] == hashlib.sha256(canonical({"entries": [], "profile": "y", "n": None}).encode()).hexdigest()


def test_scalars(spark):
    df = spark.createDataFrame([('a"b\\\n/é', 1, None, True)], "a string, b long, c string, d boolean")
    assert df.select(M.row(*[F.col(c) for c in "abcd"])).first()[0] == canonical(['a"b\\\n/é', 1, None, True])
