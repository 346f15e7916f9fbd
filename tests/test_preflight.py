"""Preflight: a case for every gate, each against a plan that passes but for it."""

import pytest
from tabulon.operators import preflight as P

PLAN = {
    "plan": "string", "plan_profile": "string", "profile": "string", "plan_structure": "string", "live_structure": "string", "expanded": "boolean", "same_output": "boolean", "in_place": "boolean", "evidence": "boolean", "expansion_needed": "boolean", "authorized": "boolean", "applied": "boolean", "apply_required": "boolean",
    "flag_needed": "boolean", "truncated": "boolean", "requires_approval": "boolean", "token": "string", "missing_required": "string", "on_conflict": "string", "lookup": "struct<table_kind: string, key_from: string, key_column: string, result_column: string, target_column: string, in_block: boolean>",
}
WRITE = {"seq": "int", "sheet": "string", "cell": "string", "source": "string", "write_policy": "string", "preview": "string", "format_compatible": "boolean", "role_compatible": "boolean"}
ID = "abcdef0123456789"
GOOD = dict.fromkeys(PLAN) | {"profile": "p", "plan_profile": "p", "plan_structure": "s", "live_structure": "s", "requires_approval": True}
FINE = {"seq": 1, "sheet": "S", "cell": "A2", "source": "K[0]", "write_policy": "write_value", "preview": "5", "format_compatible": True, "role_compatible": True}
LOOK = {"table_kind": "target_range", "key_from": "source", "key_column": "k", "result_column": "r", "target_column": "C", "in_block": True}

PLANS = {
    "fine": ({}, set()),
    "profile": ({"profile": "q"}, {("PLAN_INVALID", "profile")}),
    "stale": ({"live_structure": "t"}, {("STALE_PLAN", "structure")}),
    "stale but expanded": ({"live_structure": "t", "expanded": True}, set()),
    "no fingerprint": ({"plan_structure": None}, set()),
    "output": ({"same_output": True}, {("PLAN_INVALID", "output")}),
    "in place": ({"same_output": True, "in_place": True}, set()),
    "lookup": ({"lookup": LOOK}, set()),
    "lookup without result": ({"lookup": LOOK | {"result_column": None}}, {("PLAN_INVALID", "lookup fields")}),
    "lookup table": ({"lookup": LOOK | {"table_kind": "web"}}, {("PLAN_INVALID", "lookup table")}),
    "lookup key": ({"lookup": LOOK | {"key_from": "else"}}, {("PLAN_INVALID", "lookup key")}),
    "lookup target": ({"lookup": LOOK | {"in_block": False}}, {("PLAN_INVALID", "lookup target")}),
    "expansion": ({"evidence": True, "expansion_needed": True}, {("ROW_EXPANSION_REQUIRED", "expansion")}),
    "not applied": ({"evidence": True, "expansion_needed": True, "authorized": True, "apply_required": True}, {("EXECUTION_BLOCKED", "expansion")}),
    "dry run": ({"flag_needed": True}, {("ROW_EXPANSION_REQUIRED", "dry run")}),
    "truncated": ({"truncated": True}, {("PLAN_TRUNCATED", "would_write")}),
    "no token": ({"token": None}, {("APPROVAL_REQUIRED", "token")}),
    "wrong token": ({"token": "x"}, {("APPROVAL_INVALID", "token")}),
    "no approval asked": ({"token": None, "requires_approval": False}, set()),
    "in place asks": ({"token": None, "requires_approval": False, "in_place": True}, {("APPROVAL_REQUIRED", "token")}),
}


def test_gates_of_plans(spark):
    own = [GOOD | {"plan": f"{n:04d}{ID}", "token": f"{n:04d}{ID}"[:12]} | change for n, (change, _) in enumerate(PLANS.values())]
    df = spark.createDataFrame([tuple(r[k] for k in PLAN) for r in own], ", ".join(f"{k} {t}" for k, t in PLAN.items()))
    got = {name: set() for name in PLANS}
    for r in P.plan_gates(df).collect():
        got[list(PLANS)[int(r.plan[:4])]].add((r.code, r.subject))
    assert got == {name: want for name, (_, want) in PLANS.items()}


WRITES = {
    "fine": ({}, None, None),
    "policy": ({"write_policy": "keep"}, "PLAN_INVALID", None),
    "address": ({"cell": "A0"}, "PLAN_INVALID", None),
    "sheet": ({"sheet": "None"}, "EXECUTION_BLOCKED", None),
    "inside a merge": ({"cell": "B4"}, "MERGED_CELL_WRITE_FORBIDDEN", None),
    "corner of a merge": ({"cell": "A4"}, None, None),
    "formula": ({"cell": "A3"}, "FORMULA_MODIFICATION_FORBIDDEN", None),
    "source gone": ({"source": "K[9]"}, "SOURCE_CHANGED", None),
    "source changed": ({"preview": "6"}, "SOURCE_CHANGED", None),
    "no preview": ({"preview": None}, None, None),
    "required and empty": ({"source": "K[1]", "preview": " "}, "EXECUTION_BLOCKED", None),
    "not in the profile": ({"cell": "Z2"}, "PLAN_INVALID", None),
    "kind": ({"source": "K[2]", "preview": "text"}, "TYPE_MISMATCH", None),
    "format": ({"format_compatible": False}, "TYPE_MISMATCH", None),
    "role": ({"role_compatible": False}, None, "ROLE_MISMATCH_REPORTED"),
    "validation": ({"cell": "A7"}, "VALIDATION_MISMATCH", None),
    "odd validation": ({"cell": "A8"}, None, "UNSUPPORTED_VALIDATION"),
}


@pytest.fixture(scope="module")
def live(spark):
    make = lambda rows, schema: spark.createDataFrame([(f"p{n}", *r) for n in range(len(WRITES)) for r in rows], f"plan string, {schema}")
    return {
        "sheets": make([("S",)], "sheet string"),
        "cells": make([("S", 3, 1, "=1+1"), ("S", 2, 1, None), ("S", 4, 1, "x")], "sheet string, row int, col int, text string"),
        "merges": make([("S", "A4:B5")], "sheet string, ref string"),
        "validations": make([("S", "A7", 1, "whole", None, "1", "3"), ("S", "A8", 2, "custom", None, "=A1", None)], "sheet string, ref string, n int, type string, operator string, formula1 string, formula2 string"),
        "columns": make([("S", 1, "integer", True), ("S", 2, "integer", False)], "sheet string, col int, value_kind string, required boolean"),
        "source": make([("K", 0, "5"), ("K", 1, " "), ("K", 2, "text")], "source_key string, offset int, value string"),
    }


def test_gates_of_writes(spark, live):
    rows = [(f"p{n}", *(FINE | change).values()) for n, (change, *_) in enumerate(WRITES.values())]
    writes = spark.createDataFrame(rows, "plan string, " + ", ".join(f"{k} {t}" for k, t in WRITE.items()))
    got = {r.plan: (r.code, r.warning) for r in P.checked_writes(writes, live, live["source"]).collect()}
    assert {name: got[f"p{n}"] for n, name in enumerate(WRITES)} == {name: (code, warning) for name, (_, code, warning) in WRITES.items()}


def test_one_report(spark, live):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    plans = make([tuple((GOOD | {"plan": p, "token": p[:12], "missing_required": m, "on_conflict": c})[k] for k in PLAN) for p, m, c in (("p0", None, None), ("p1", "block", "report"), ("p2", None, None))], ", ".join(f"{k} {t}" for k, t in PLAN.items()))
    lists = {"blocked": make([("p0", "source value is empty for a required target"), ("p1", "a required one")], "plan string, reason string"), "conflicts": make([("p0", "x"), ("p1", "y")], "plan string, what string"), "unresolved": make([("p0",), ("p1",)], "plan string")}
    writes = make([("p0", *FINE.values()), ("p0", *(FINE | {"seq": 2}).values()), ("p1", *(FINE | {"cell": "A3"}).values())], "plan string, " + ", ".join(f"{k} {t}" for k, t in WRITE.items()))
    decisions = make([("p0", "first_run"), ("p1", "conflict")], "plan string, decision string")
    got = {tuple(r) for r in P.preflight(plans, lists, writes, live, live["source"], decisions).collect()}
    assert got == {
        ("p0", "EXECUTION_BLOCKED", "conflicts"), ("p0", "PLAN_INVALID", "duplicate S!A2"), ("p1", "EXECUTION_BLOCKED", "blocked cells"), ("p1", "EXECUTION_BLOCKED", "unresolved"),
        ("p1", "FORMULA_MODIFICATION_FORBIDDEN", "S!A3"), ("p1", "PLAN_CONFLICT", "conflict"),
    }
    none = {k: df.limit(0) for k, df in live.items()}
    assert P.preflight(plans.limit(0), {k: df.limit(0) for k, df in lists.items()}, writes.limit(0), none, none["source"]).collect() == []


def test_lists_follow_the_policy(spark):
    plans = spark.createDataFrame([("a", None, None), ("b", "block", "report")], "plan string, missing_required string, on_conflict string")
    none = spark.createDataFrame([], "plan string, reason string")
    hard = spark.createDataFrame([("a", "merged"), ("b", None)], "plan string, reason string")
    got = {(r.plan, r.subject) for r in P.list_gates(plans, hard, none.select("plan"), none.select("plan")).collect()}
    assert got == {("a", "blocked cells"), ("b", "blocked cells")}
