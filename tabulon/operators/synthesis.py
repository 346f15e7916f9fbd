"""Formulas for new cells from the families above them: a gated plan, what is to hold after it is carried out, and why formulas are refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formulas import DYNAMIC, LATE_BOUND, copy_down, parse_formula
from .transactions import as_of

CELL = ["sheet", "row", "col"]


def with_ids(families_: DataFrame) -> DataFrame:
    """families() with ``family_id``: sheet, orientation, line and first place, which name a family whatever else changes."""
    place = F.concat_ws(":", F.col("orientation"), F.col("line").cast("string"), F.col("start").cast("string"))
    return families_.withColumn("family_id", F.concat_ws("!", F.col("sheet"), place))


def nearest_families(targets: DataFrame, families_: DataFrame) -> DataFrame:
    """targets with ``near``: the id of the nearest vertical family that ends above in the same column, of those that may be copied.

    These are of HIGH confidence and without unsupported members; a nearer family that may not be copied is passed over.
    Of several that end in one row the one with more members counts, then the first id.
    """
    usable = families_.where("orientation = 'vertical' and confidence = 'HIGH' and eligible")
    best = usable.groupBy("sheet", F.col("line").alias("col"), (F.col("end") + 1).alias("row")).agg(F.min_by("family_id", F.struct(-F.col("members"), F.col("family_id"))).alias("near"))
    return as_of(targets, best, ["sheet", "col"], "row", [], ["near"]).drop("row_found")


def plan(targets: DataFrame, families_: DataFrame, texts: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """One row for each target: the formula that its family gives it, or the code of the first gate that it fails.

    ``targets``: sheet, row, col, family_id (null: the nearest one), has_formula (null: unknown); each cell once.
    ``families_``: with_ids(families()). ``texts``: sheet, row, col, text of formulas. ``allowed``: sheet, row, col of cells
    that may be written; without it all may. Gives sheet, row, col, family_id, source_row, moved (rows), window,
    confidence, signature, blocked and formula. A target without row or column has an unknown state. A translated
    formula is read again and must have its family's signature.
    """
    auto = nearest_families(targets.where("family_id is null and row is not null and col is not null"), families_).withColumn("family_id", F.col("near")).drop("near")
    rest = targets.where("family_id is not null or row is null or col is null")
    chosen = auto.unionByName(rest)
    f = families_.select(F.col("family_id"), F.col("sheet").alias("home"), "orientation", "line", F.col("start").alias("source_row"), "confidence", "eligible", "window", "signature")
    vertical = F.col("orientation") == "vertical"
    out = chosen.join(f, "family_id", "left")
    source = texts.select(F.col("sheet").alias("home"), F.col("row").alias("source_row"), F.col("col").alias("line"), F.col("text"))
    out = out.join(source, ["home", "source_row", "line"], "left")
    if allowed is None:
        out = out.withColumn("may", F.lit(True))
    else:
        out = out.join(allowed.select(*CELL).distinct().withColumn("may", F.lit(True)), CELL, "left")
    out = out.withColumn("moved", F.when(vertical, F.col("row") - F.col("source_row")))
    out = out.withColumn("made", copy_down(F.when(vertical, F.col("text")), F.coalesce("moved", F.lit(0))))
    out = out.withColumn("again", parse_formula(F.col("made"), F.col("row"), F.col("col")))
    state = F.lit("TARGET_STATE_UNKNOWN")
    nowhere = F.col("row").isNull() | F.col("col").isNull()
    code = (
        F.when(nowhere & F.col("family_id").isNull(), state)
        .when(F.col("orientation").isNull(), "NO_SOURCE_FAMILY")
        .when(~vertical, "TARGET_COLUMN_MISMATCH")
        .when(F.col("confidence") != "HIGH", "FAMILY_CONFIDENCE_BELOW_HIGH")
        .when(~F.coalesce("eligible", F.lit(False)), "FAMILY_UNSUPPORTED_CONSTRUCT")
        .when(F.coalesce("window", F.lit("UNKNOWN_WINDOW")) == "UNKNOWN_WINDOW", "WINDOW_PATTERN_NOT_DETERMINISTIC")
        .when(F.col("may").isNull(), "TARGET_NOT_ALLOWED")
        .when(nowhere | F.col("has_formula").isNull(), state)
        .when(F.col("has_formula"), "TARGET_ALREADY_FORMULA")
        .when(F.coalesce("text", F.lit("")) == "", "SOURCE_TEXT_UNAVAILABLE")
        .when(F.col("line") != F.col("col"), "TARGET_COLUMN_MISMATCH")
        .when(F.col("made").isNull(), "TRANSLATION_FAILED")
        .when(F.size("again.unsupported") > 0, "FAMILY_UNSUPPORTED_CONSTRUCT")
        .when(~F.col("again.signature").eqNullSafe(F.col("signature")), "REFERENCE_TRANSLATION_MISMATCH")
    )
    out = out.withColumn("blocked", code)
    return out.select(*CELL, "family_id", "source_row", "moved", "window", "confidence", "signature", "blocked", F.when(F.col("blocked").isNull(), F.col("made")).alias("formula"))


def expectations(plan_: DataFrame) -> DataFrame:
    """sheet, check and expected: how many cells of each sheet are to pass each check once the plan is carried out."""
    checks = ["formula_count_delta", "formula_exists", "syntax_preserved", "signature_matched", "offsets_matched", "absolute_preserved", "sheets_preserved"]
    n = plan_.groupBy("sheet").agg(F.count_if(F.col("blocked").isNull()).alias("n"))
    own = n.select("sheet", F.explode(F.array(*map(F.lit, checks))).alias("check"), F.col("n").alias("expected"))
    return own.unionByName(n.select("sheet", F.lit("unrelated_changed").alias("check"), F.lit(0).cast("long").alias("expected")))


def verified(plan_: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """sheet, check, expected, found and passed: whether formulas of ``after`` are those of ``before`` and the plan's, and nothing else.

    ``before`` and ``after``: sheet, row, col and text of all formula cells (other cells have no row). Only sheets of
    the plan and sheets whose formulas changed are reported; values aren't computed, so nothing is said of them.
    """
    texts = before.select(*CELL, F.col("text").alias("old")).join(after.select(*CELL, F.col("text").alias("new")), CELL, "full")
    actions = plan_.where("blocked is null").select(*CELL, "formula", "signature", F.lit(True).alias("planned"))
    both = texts.join(actions, CELL, "full").where("planned or not (old <=> new)")
    for c in ("formula", "new"):
        both = both.withColumn(f"p_{c}", parse_formula(F.when(F.col("planned"), F.col(c)), F.col("row"), F.col("col")))
    parts = lambda c, pattern: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))
    fixed, sheets = r"\$[A-Za-z]*\$?[0-9]*", r"('(?:[^']|'')+'|[A-Za-z_][A-Za-z0-9_.]*)!"
    same = lambda pattern: parts("new", pattern) == parts("formula", pattern)
    there, own = F.coalesce(F.col("new").startswith("="), F.lit(False)), F.coalesce("planned", F.lit(False))
    signs = {
        "formula_exists": there, "syntax_preserved": F.col("new").eqNullSafe(F.col("formula")), "signature_matched": F.col("p_new.signature").eqNullSafe(F.col("signature")),
        "offsets_matched": F.transform("p_new.refs", lambda r: r["text"]) == F.transform("p_formula.refs", lambda r: r["text"]), "absolute_preserved": same(fixed), "sheets_preserved": same(sheets),
    }
    delta = F.sum(F.when(F.col("new").isNotNull(), 1).otherwise(0) - F.when(F.col("old").isNotNull(), 1).otherwise(0))
    counts = {"formula_count_delta": delta, "unrelated_changed": F.count_if(~own)} | {n: F.count_if(own & there & s) for n, s in signs.items()}
    found = both.groupBy("sheet").agg(*[c.alias(n) for n, c in counts.items()])
    long = found.select("sheet", F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("found")) for n in counts])).alias("x")).select("sheet", "x.*")
    out = expectations(plan_).join(long, ["sheet", "check"], "full").withColumns({"expected": F.coalesce("expected", F.lit(0)), "found": F.coalesce("found", F.lit(0))})
    return out.withColumn("passed", F.col("expected") == F.col("found"))


def unsupported_reasons(text: Column, functions: Column) -> Column:
    """Every reason, sorted, why a formula isn't copied; none for a text that is no formula's. ``functions``: names in it, in capitals.

    Texts in quotes don't count.
    """
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), '"(?:[^"]|"")*"', " ")
    brackets, braces = bare.rlike(r"[\[\]]"), bare.rlike("[{}]")
    future, broken = bare.contains("_xlfn."), bare.contains("#REF!")
    leading = bare.rlike(r"^=[=\s]*[-+*/]")
    copied = (
        F.when(~bare.startswith("="), None).when(braces, "array or constant formula").when(future, "future function (_xlfn)").when(broken, "broken reference (#REF!)")
        .when(brackets, "structured or external reference").when(leading, "formula without a leading reference is not a supported copy-down pattern")
    )
    among = lambda names: F.array_sort(F.array_intersect(functions, F.array(*map(F.lit, names))))
    listed = lambda title, names: F.when(F.size(among(names)) > 0, F.concat(F.lit(title), F.array_join(among(names), ",")))
    found = [
        copied, F.when(bare.rlike(r"\[[^\]'\s]+\]"), "external workbook reference"), F.when(brackets, "structured reference"), F.when(braces, "array or constant formula"),
        F.when(F.lower(bare).contains("_xlfn."), "future function (_xlfn)"), F.when(broken, "broken reference (#REF!)"),
        listed("dynamic array function: ", DYNAMIC), listed("late-bound function: ", [f for f in LATE_BOUND if f != "RTD"]),
    ]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))
