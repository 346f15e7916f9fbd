"""Repeated structures: hand-made cases for each rule, and scans row by row of random sheets."""

import random

from pyspark.sql import functions as F

from tabulon.operators import repeats as R
from tabulon.plans import QUERIES, registry

ROWS = "sheet string, row int, nonempty int, first_col int, last_col int, sig string"


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def sheet(name, sigs):
    """Rows by their signatures; an empty signature is an empty row."""
    return [(name, i + 1, len(s.replace(".", "")), 1 if s else None, len(s) or None, s) for i, s in enumerate(sigs)]


def scan(sigs, cover=None):
    """A band row by row: period, start, end."""
    runs = []
    for k, s in enumerate(sigs):
        if runs and runs[-1][0] == s:
            runs[-1][2] = k
        else:
            runs.append([s, k, k])
    covered = {k for s, a, b in runs if sum(r[0] == s for r in runs) > 1 for k in range(a, b + 1)}
    out, seen = [], set()
    for p in range(2, 7):
        best, i = None, 0
        while i < len(sigs):
            j = i + p
            while j < len(sigs) and sigs[j] == sigs[j - p]:
                j += 1
            if j - i >= max(2 * p, 4):
                if best is None or j - i > best[1] - best[0] + 1:
                    best = (i, j - 1)
                i = j
            else:
                i += 1
        if best:
            own = set(range(best[0], best[1] + 1))
            if len({sigs[k] for k in own}) > 1 and not own <= seen and not (cover and len(own & covered) >= cover * len(own)):
                seen |= own
                out.append((p, *best))
    return out


def test_blocks(spark):
    sigs = ["tt", "tii", "tii", "tt", "tii", "t..q", "", "t", "t", "", "tn", "tn", "tn", "", "t...", "tttt", "t...", "tttt", "t...", "tttt"]
    got = rows_of(R.repeated_blocks(spark.createDataFrame(sheet("S", sigs), ROWS)).drop("sheet"))
    # the first band is four wide; of the second two rows are too few; the third is one run
    assert {g[1:] for g in got if g[0] == 1} == {
        ("tt..", 1, 1, "A1:B1", 2, 1, 65, "MEDIUM"), ("tt..", 4, 4, "A4:B4", 2, 1, 65, "MEDIUM"), ("tii.", 2, 3, "A2:C3", 2, 2, 65, "MEDIUM"), ("tii.", 5, 5, "A5:C5", 2, 2, 65, "MEDIUM"),
    }
    assert {g[0] for g in got} == {1, 15}
    assert {(g[1], g[5], g[7], g[8]) for g in got if g[0] == 15} == {("t...", 3, 45, "LOW"), ("tttt", 3, 80, "HIGH")}


def test_blocks_of_nothing(spark):
    none = spark.createDataFrame([], ROWS)
    assert R.repeated_blocks(none).count() == 0 and R.periods(none).count() == 0 and R.pattern_blocks(R.repeated_blocks(none)).count() == 0
    odd = spark.createDataFrame([("S", r, 1, None, None, None) for r in (1, 2, 3)] + [(None, r, 1, 1, 1, "ab"[r % 2]) for r in range(1, 7)], ROWS).withColumn("band", F.lit("x"))
    assert rows_of(R.repeated_blocks(odd).select("sheet", "band", "signature").distinct()) == {(None, 1, "a"), (None, 1, "b")}


def test_patterns_as_blocks(spark):
    found = R.repeated_blocks(spark.createDataFrame(sheet("S", ["tt", "ti", "tt", "ti", "tq"]), ROWS))
    assert rows_of(R.pattern_blocks(found).select("block_id", "archetype", "row_archetype", "occurrences", "rows_per_run", "evidence")) == {
        ("p" + s, "repeated_pattern", "record_row", 2, 1, f"repeated_type:repeated_row_block;occurrences:2;signature:{s}") for s in ("tt", "ti")
    }


def test_periods(spark):
    cases = {
        "two": list("ababab") + ["c"], "flat": list("aaaaaa"), "short": list("aba"), "three": list("xabcabcy"), "six": list("abcdefabcdef"),
        # four is two twice: its stretch lies in that of two
        "again": list("abababab"),
        # the stretch of three begins before that of two ends
        "joined": list("ababaabaab"),
    }
    got = rows_of(R.periods(spark.createDataFrame([r for n, s in cases.items() for r in sheet(n, s)], ROWS)).select("sheet", "period", "first_row", "last_row"))
    assert got == {(n, p, a + 1, b + 1) for n, s in cases.items() for p, a, b in scan(s)}
    assert ("two", 2, 1, 6) in got and ("three", 3, 2, 7) in got and ("six", 6, 1, 12) in got and {g[1] for g in got if g[0] == "again"} == {2}
    one = R.periods(spark.createDataFrame(sheet("S", list("xabcabcab")), ROWS)).first()
    assert (one.unit, one.occurrences, one.score, one.level, one.covered) == ("a / b / c", 2, 65, "MEDIUM", 8)


def test_random_bands_as_scanned(spark):
    rng, cases = random.Random(7), {}
    for k in range(400):
        letters, out = "ab" if k % 3 else "abc", []
        while len(out) < rng.randint(3, 60):
            # stretches of small periods side by side, so that their ends overlap
            unit = [rng.choice(letters) for _ in range(rng.randint(1, 6))]
            out += (unit * 4)[: rng.randint(1, 16)]
        cases[f"s{k}"] = out
    df = spark.createDataFrame([r for n, s in cases.items() for r in sheet(n, s)], ROWS)
    got = rows_of(R.periods(df).select("sheet", "period", "first_row", "last_row"))
    assert got == {(n, p, a + 1, b + 1) for n, s in cases.items() for p, a, b in scan(s)} and len(got) > 300
    # every row of such a stretch is in a repeated block
    assert R.periods(df).where("covered <> last_row - first_row + 1").count() == 0
    assert R.periods(df, 0.8).count() == 0 and not any(scan(s, 0.8) for s in cases.values())


def test_headers(spark):
    heads = {1: ["date", "item", "sum"], 9: ["date", "item", "sum"], 15: ["date", "item", "total"], 20: ["code", "name", None], 30: ["code", None, "total"], 40: [None, None, None], 50: ["date", "other", "new"]}
    labels = spark.createDataFrame([("S", r, c + 1, v) for r, h in heads.items() for c, v in enumerate(h)] + [("T", 3, 1, "date")], "sheet string, row int, col int, label string")
    # 15 shares two of three with 1; 30 shares one of one with 20 and one of two with 15
    assert rows_of(R.repeated_headers(labels).select("sheet", "row", "repeats", "occurrence")) == {("S", 9, 1, 2), ("S", 15, 1, 3), ("S", 30, 20, 2)}


def test_tasks_do_not_grow_with_the_table(spark, monkeypatch):
    want = rows_of(QUERIES["repeated_blocks"](spark, "/root/testdata/sf0.001"))
    monkeypatch.setattr(registry, "DEALT", 500)
    got = QUERIES["repeated_blocks"](spark, "/root/testdata/sf0.001")
    # as many partitions as the line items need, and three orders in all: by date, by row and by what is alike
    assert got.rdd.getNumPartitions() == -(-spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() // 500)
    assert rows_of(got) == want
    body = R.repeated_blocks(spark.createDataFrame(sheet("S", ["tt", "ti", "tt", "ti", "tq"]), ROWS))
    assert body._jdf.queryExecution().executedPlan().toString().count("Sort [") == 3
