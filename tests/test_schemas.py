"""Schemas as rows: a case for each rule, nested ones too, and tables out of JSON sources."""

import pytest
from pyspark.sql import functions as F

from tabulon.sources import schemas as S

ROWS = [
    ("book", "title", True, "str", None, False), ("book", "size", False, "int", None, False), ("book", "ratio", False, "number", None, False), ("book", "on", False, "bool", None, False), ("book", "free", False, None, None, False), ("book", "style", False, "str_or_dict", None, False),
    ("book", "sheets", True, "list", "sheet", True), ("book", "page", False, "dict", "page", False), ("sheet", "name", True, "str", None, False), ("sheet", "cells", False, None, "cell", True), ("cell", "at", True, "str", None, False), ("page", "width", True, "number", None, False),
]
DOCS = {
    "fine": ('{"title": "t", "sheets": [{"name": "a", "cells": [{"at": "A1"}]}], "size": 3, "ratio": 1.5, "on": true, "free": [1], "style": {}, "page": {"width": 1}}', set()),
    "root": ("[1]", {("<root>", "SPEC_INVALID", "dict", "list", None)}),
    "nothing": ("null", {("<root>", "SPEC_INVALID", "dict", "null", None)}),
    "missing": ("{}", {("title", "SPEC_INVALID", "required key present", "missing", None), ("sheets", "SPEC_INVALID", "required key present", "missing", None)}),
    "types": ('{"title": 1, "sheets": [], "size": true, "ratio": "x", "on": 0, "style": 1.5, "page": null}', {("title", "SPEC_INVALID", "str", "int", None), ("size", "SPEC_INVALID", "int", "bool", None), ("ratio", "SPEC_INVALID", "number", "str", None), ("on", "SPEC_INVALID", "bool", "int", None), ("style", "SPEC_INVALID", "str_or_dict", "float", None), ("page", "SPEC_INVALID", "dict", "null", None)}),
    "unknown": ('{"titel": "t", "title": "t", "sheets": [], "zzzz": []}', {("titel", "SPEC_UNKNOWN_KEY", "known key", "unknown key (str)", "title"), ("zzzz", "SPEC_UNKNOWN_KEY", "known key", "unknown key (list)", None)}),
    "nested": ('{"title": "t", "sheets": [{"name": "a"}, {"nam": 1, "cells": [{"at": "A1"}, {"at": 2}, 7]}], "page": {"height": 2}}', {
        ("sheets[1].name", "SPEC_INVALID", "required key present", "missing", None), ("sheets[1].nam", "SPEC_UNKNOWN_KEY", "known key", "unknown key (int)", "name"), ("sheets[1].cells[1].at", "SPEC_INVALID", "str", "int", None),
        ("sheets[1].cells[2]", "SPEC_INVALID", "dict", "int", None), ("page.width", "SPEC_INVALID", "required key present", "missing", None), ("page.height", "SPEC_UNKNOWN_KEY", "known key", "unknown key (int)", "width"),
    }),
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t) for k, (t, _) in DOCS.items()], "path string, text string").select("path", F.try_parse_json("text").alias("value"))


def test_every_rule(spark, docs):
    import difflib

    got = {k: set() for k in DOCS}
    for r in S.problems(docs, S.schema_rows(spark, ROWS), "book", strict=True).collect():
        got[r.path].add((r.at, r.code, r.expected, r.actual, r.nearest))
    want = {k: {(*w[:4], (difflib.get_close_matches(w[0].split(".")[-1], [r[1] for r in ROWS if r[0] == ("page" if w[0].startswith("page.") else "sheet" if "[" in w[0] else "book")], 1, 0.5) or [None])[0]) if w[1] == "SPEC_UNKNOWN_KEY" else w for w in ws} for k, (_, ws) in DOCS.items()}
    assert got == want


def test_unknown_keys_are_told_where_they_may_stay(spark, docs):
    got = S.problems(docs.where("path = 'unknown'"), S.schema_rows(spark, ROWS), "book").collect()
    assert {(r.at, r.code, r.nearest) for r in got} == {("titel", "UNKNOWN_SPEC_KEY", None), ("zzzz", "UNKNOWN_SPEC_KEY", None)}
    assert S.problems(docs.limit(0), S.schema_rows(spark, ROWS), "book").collect() == []


def test_tables_of_sources(spark):
    text = '{"tables": {"t": {"headers": ["k", "v"], "rows": [["a", 1], ["b"], [null, true, "more"]]}, "bare": {"headers": [], "rows": []}, "odd": 3}}'
    docs = spark.createDataFrame([("p", text), ("q", "{}")], "path string, text string").select("path", F.parse_json("text").alias("value"))
    got = sorted((r.path, r.table, r.row, r.column, r.value or "-") for r in S.source_tables(docs).collect())
    assert got == [("p", "t", 0, "k", "a"), ("p", "t", 0, "v", "1"), ("p", "t", 1, "k", "b"), ("p", "t", 1, "v", "-"), ("p", "t", 2, "k", "-"), ("p", "t", 2, "v", "true")]
