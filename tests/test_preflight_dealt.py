"""Preflight deals its tables by plan once, and finds by order what joins would find."""

import random
from collections import Counter

import pytest

from tabulon.operators import preflight as P
from tabulon.plans import QUERIES

DIR = "/root/testdata/sf0.001"


def shuffled(spark):
    """Rows that all stages so far have written for others."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark._jvm
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


@pytest.mark.parametrize("partitions", [4, 60])
def test_lines_are_dealt_once(spark, monkeypatch, partitions):
    """As over large tables: no broadcasts, and more tasks than Spark's number in the second case."""
    monkeypatch.setattr("tabulon.plans.preflight.DEALT", 100, raising=False)
    lines, orders = (spark.read.parquet(f"{DIR}/{t}.parquet").count() for t in ("lineitem", "orders"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": str(partitions)}
    kept = {k: spark.conf.get(k) for k in settings}
    want = Counter(map(tuple, QUERIES["preflight_blockers"](spark, DIR).collect()))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = QUERIES["preflight_blockers"](spark, DIR)
        before = shuffled(spark)
        assert Counter(map(tuple, df.collect())) == want
        sent = sum(n for stage, n in shuffled(spark).items() if stage not in before)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert lines < sent < lines + 4 * orders  # a table of orders, its merges, and the lists' joins


SHEETS = {f"p{n}": ["S", "T"][: 1 + n % 2] for n in range(8)}
RANGES = {"A1:B70": (1, 1, 70, 2), "B64": (64, 2, 64, 2), "A60:C65": (60, 1, 65, 3), "C3:C3 A130:B200": None, "no range": None}


def inside(ref, row, col):
    parts = {"C3:C3 A130:B200": [(3, 3, 3, 3), (130, 1, 200, 2)], "no range": []}.get(ref) or ([RANGES[ref]] if RANGES[ref] else [])
    return any(a <= row <= c and b <= col <= d for a, b, c, d in parts)


def test_found_by_order_as_by_search(spark):
    rng = random.Random(5)
    places = [(r, c) for r in (1, 3, 63, 64, 65, 127, 128, 130, 200) for c in (1, 2, 3)]
    some = lambda rows, n: [rng.choice(rows) for _ in range(n)]
    sheets = [(p, s) for p, ss in SHEETS.items() for s in ss] * 2
    cells = [(p, s, r, c, rng.choice(["=1", "x", None])) for p, s in sorted(set(sheets)) for r, c in some(places, 12)]
    merges = [(p, s, ref) for p, s in sorted(set(sheets)) for ref in some(list(RANGES), 1)]
    rules = [(p, s, ref, rng.choice([1, 2, 3, 4, 5]) * 100 + i, "whole", None, str(rng.randrange(3)), "5") for p, s in sorted(set(sheets)) for i, ref in enumerate(some(list(RANGES), 4))]
    columns = [(p, s, c, rng.choice(["integer", "string"]), rng.random() < 0.5) for p, s in sorted(set(sheets)) for c in (1, 2)]
    source = [(p, k, i, rng.choice(["1", "4", "9", "x", " ", None])) for p in SHEETS for k in ("K", "L") for i in range(4)]
    spell = lambda r, c: rng.choice(["{}{}", "${}${}"]).format("ABC"[c - 1], r)
    writes = [(p, i, rng.choice(["S", "T", "U"]), rng.choice([spell(*rng.choice(places))] * 9 + ["A0", None]), f"{rng.choice('KLM')}[{rng.randrange(5)}]", "write_value", None, True, True) for p in SHEETS for i in range(150)]
    make = spark.createDataFrame
    live = {
        "sheets": make(sheets, "plan string, sheet string"),
        "cells": make(cells, "plan string, sheet string, row int, col int, text string"),
        "merges": make(merges, "plan string, sheet string, ref string"),
        "validations": make(rules, "plan string, sheet string, ref string, n int, type string, operator string, formula1 string, formula2 string"),
        "columns": make(columns, "plan string, sheet string, col int, value_kind string, required boolean"),
    }
    types = "plan string, seq int, sheet string, cell string, source string, write_policy string, preview string, format_compatible boolean, role_compatible boolean"
    got = P.checked_writes(make(writes, types), live, make(source, "plan string, source_key string, offset int, value string")).collect()

    first, times = {}, Counter()
    for w in writes:
        first.setdefault((w[0], w[2], w[3]), w)
        times[(w[0], w[2], w[3])] += 1
    values = {(p, f"{k}[{i}]"): v for p, k, i, v in source}
    kinds = {(p, s, c): (kind, needed) for p, s, c, kind, needed in columns}

    def code(p, s, cell, ref):
        if cell in ("A0", None):
            return "PLAN_INVALID"
        bare = cell.replace("$", "")
        r, c = int(bare[1:]), "ABC".index(bare[0]) + 1
        if (p, s) not in sheets:
            return "EXECUTION_BLOCKED"
        corners = {"A1:B70": (1, 1), "B64": (64, 2), "A60:C65": (60, 1), "C3:C3 A130:B200": (3, 3)}
        merged = [corners[m] for q, t, m in sorted(merges) if (q, t) == (p, s) and inside(m, r, c)]
        if merged and merged[0] != (r, c):
            return "MERGED_CELL_WRITE_FORBIDDEN"
        if any(x[:4] == (p, s, r, c) and x[4] == "=1" for x in cells):
            return "FORMULA_MODIFICATION_FORBIDDEN"
        if (p, ref) not in values:
            return "SOURCE_CHANGED"
        v, (kind, needed) = values[(p, ref)], kinds.get((p, s, c), (None, False))
        if not (v or "").strip() and needed:
            return "EXECUTION_BLOCKED"
        if kind is None:
            return "PLAN_INVALID"
        mine = "integer" if v in ("1", "4", "9") else "blank" if not (v or "").strip() else "string"
        if mine != "blank" and mine != kind:
            return "TYPE_MISMATCH"
        over = [x for x in sorted(rules, key=lambda x: x[3]) if x[:2] == (p, s) and inside(x[2], r, c)]
        if over and not (mine == "integer" and int(over[0][6]) <= int(v) <= 5):
            return "VALIDATION_MISMATCH"
        return None

    assert Counter((r.plan, r.sheet, r.cell, r.code, r.again) for r in got) == Counter((p, s, cell, code(p, s, cell, w[4]), times[(p, s, cell)] > 1) for (p, s, cell), w in first.items())
    assert len({r.code for r in got}) == 8  # all codes, and none


def test_a_place_that_is_told_twice_gives_one_row(spark, live_one):
    writes, live, source = live_one
    twice = {k: df.unionByName(df) for k, df in live.items()}
    one = P.checked_writes(writes, live, source).collect()
    assert len(one) == 1
    assert P.checked_writes(writes, twice, source.unionByName(source)).collect() == one


@pytest.fixture
def live_one(spark):
    make = spark.createDataFrame
    writes = make([("p", 1, "S", "A2", "K[0]", "write_value", "5", True, True)], "plan string, seq int, sheet string, cell string, source string, write_policy string, preview string, format_compatible boolean, role_compatible boolean")
    live = {
        "sheets": make([("p", "S")], "plan string, sheet string"),
        "cells": make([("p", "S", 2, 1, "x")], "plan string, sheet string, row int, col int, text string"),
        "merges": make([("p", "S", "A2:B2")], "plan string, sheet string, ref string"),
        "validations": make([("p", "S", "A1:A9", 1, "whole", None, "1", "9")], "plan string, sheet string, ref string, n int, type string, operator string, formula1 string, formula2 string"),
        "columns": make([("p", "S", 1, "integer", True)], "plan string, sheet string, col int, value_kind string, required boolean"),
    }
    return writes, live, make([("p", "K", 0, "5")], "plan string, source_key string, offset int, value string")
