"""Everything that must hold before a fill plan is carried out, for any number of plans at once.

Gates are relations of (plan, code, subject), of plans as a whole and of their planned
writes; one union of them is the report. A write is told by the first gate that it
fails, in the order of the gates. Nothing is written here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.infer import compatible, infer_source
from ..functions.refs import parse_a1
from .filling import PREVIEW, band, by_band, check_validation, first_of

# The characters of a plan's id that approve it, and the kinds of lookup tables.
TOKEN = 12
LOOKUPS = ["source_json_tables", "target_range"]
#: What is read of writes, and of the workbooks as they are.
WRITTEN = ["plan", "seq", "sheet", "cell", "source", "write_policy", "preview", "format_compatible", "role_compatible"]
LIVE = ["sheets", "cells", "merges", "validations", "columns"]
#: What repartition() gets for every table of a plan.
DEALT = ("plan",)


def _of_plan(codes: list[tuple[str, str, Column]], plans: DataFrame) -> DataFrame:
    """plan, code, subject of the plans for which a condition holds."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(subject).alias("subject"))) for code, subject, c in codes]))
    return plans.select("plan", F.inline(found))


def plan_gates(plans: DataFrame) -> DataFrame:
    """plan, code, subject of what speaks against plans as a whole.

    ``plans``: plan, plan_profile and profile (ids), plan_structure and live_structure
    (fingerprints), expanded (rows were added before this, so that the fingerprint
    was held against the workbook as it was), same_output, in_place, evidence
    (whether the plan carries blocks to expand), expansion_needed, authorized, applied,
    apply_required, flag_needed (a dry run's word where there is no evidence),
    truncated, requires_approval, token, and lookup: a struct of table_kind, key_from,
    key_column, result_column, target_column and in_block, null where none is carried out.
    """
    c, yes = F.col, lambda x: F.coalesce(F.col(x), F.lit(False))
    look = lambda x: F.col(f"lookup.{x}")
    there, empty = c("lookup").isNotNull(), lambda x: F.coalesce(look(x), F.lit("")) == ""
    asks = F.coalesce(c("requires_approval"), F.lit(True)) | yes("in_place")
    token = F.coalesce(c("token"), F.lit(""))
    return _of_plan(
        [
            ("PLAN_INVALID", "profile", (F.coalesce(c("plan_profile"), F.lit("")) != "") & ~c("plan_profile").eqNullSafe(c("profile"))),
            ("STALE_PLAN", "structure", c("plan_structure").isNotNull() & ~yes("expanded") & ~c("plan_structure").eqNullSafe(c("live_structure"))),
            ("PLAN_INVALID", "output", yes("same_output") & ~yes("in_place")),
            ("PLAN_INVALID", "lookup fields", there & (empty("table_kind") | (empty("key_from") & empty("key_column")) | empty("result_column") | empty("target_column"))),
            ("PLAN_INVALID", "lookup table", there & ~F.coalesce(look("table_kind").isin(LOOKUPS), F.lit(False))),
            ("PLAN_INVALID", "lookup key", there & (~F.coalesce(look("key_from") == "source", F.lit(False)) | empty("key_column"))),
            ("PLAN_INVALID", "lookup target", there & ~empty("target_column") & ~F.coalesce(look("in_block"), F.lit(False))),
            ("ROW_EXPANSION_REQUIRED", "expansion", yes("evidence") & yes("expansion_needed") & ~yes("authorized")),
            ("EXECUTION_BLOCKED", "expansion", yes("evidence") & yes("apply_required") & yes("authorized") & ~yes("applied")),
            ("ROW_EXPANSION_REQUIRED", "dry run", ~yes("evidence") & yes("flag_needed")),
            ("PLAN_TRUNCATED", "would_write", yes("truncated")),
            ("APPROVAL_REQUIRED", "token", asks & (token == "")),
            ("APPROVAL_INVALID", "token", asks & (token != "") & (token != F.left("plan", F.lit(TOKEN)))),
        ],
        plans,
    )


def list_gates(plans: DataFrame, blocked: DataFrame, conflicts: DataFrame, unresolved: DataFrame) -> DataFrame:
    """plan, code, subject for plans that carry blocked cells, conflicts or open mappings which their policy doesn't pass.

    ``plans``: plan, missing_required, on_conflict (null: block); ``blocked``: plan,
    reason; the others: plan. Of blocked cells, those that only lack a required value
    pass unless the policy blocks them.
    """
    strict = F.coalesce(F.col("missing_required") == "block", F.lit(False))
    hard = blocked.join(plans, "plan").where(~F.contains(F.coalesce("reason", F.lit("")), F.lit("required")) | strict)
    open_ = unresolved.join(plans, "plan").where(strict)
    odd = conflicts.join(plans, "plan").where(F.coalesce("on_conflict", F.lit("block")) == "block")
    said = lambda df, what: df.select("plan").distinct().select("plan", F.lit("EXECUTION_BLOCKED").alias("code"), F.lit(what).alias("subject"))
    return said(hard, "blocked cells").unionByName(said(odd, "conflicts")).unionByName(said(open_, "unresolved"))


def _facts(writes: DataFrame, *facts: DataFrame) -> DataFrame:
    """Writes (side 1) and what is known of the places that they name (side 0), in one relation."""
    both = writes.withColumn("side", F.lit(1))
    for f in facts:
        both = both.unionByName(f.withColumn("side", F.lit(0)), allowMissingColumns=True)
    return both


def _of_places(w: DataFrame, live: dict[str, DataFrame]) -> DataFrame:
    """The first write of each cell with again (there are others), there, corner, rule and formula_now, in one ordered pass over each sheet.

    In its order a fact comes before the writes that it holds for: a sheet before its
    bands, a band's ranges before its cells, a cell before its writes.
    """
    merges = live["merges"].withColumn("corner", parse_a1(F.split("ref", ":")[0]))
    both = _facts(
        w.withColumn("band", band(F.col("row"))),
        live["sheets"].select("plan", "sheet", F.lit(True).alias("there")),
        by_band(merges, ["corner"], "ref", ["plan", "sheet"], "merges"),
        by_band(live["validations"], ["type", "operator", "formula1", "formula2"], "n", ["plan", "sheet"], "rules"),
        live["cells"].select("plan", "sheet", band(F.col("row")).alias("band"), "row", "col", F.startswith(F.coalesce("text", F.lit("")), F.lit("=")).alias("formula")),
    )
    order = Window.partitionBy("plan", "sheet").orderBy("band", "row", "col", "side", "formula", "cell", "seq")
    known = lambda c, *at: F.last(F.when(F.col(c).isNotNull(), F.struct(*at, c)), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    entry = F.struct("side", "cell")
    seen = both.withColumns({
        "first": ~F.lag(entry).over(order).eqNullSafe(entry), "again": F.lead(entry).over(order).eqNullSafe(entry), "known_sheet": known("there"),
        "known_merges": known("merges", "band"), "known_rules": known("rules", "band"), "known_cell": known("formula", "row", "col"),
    }).where("side = 1 and first")
    row, col = F.col("row"), F.col("col")
    covering = lambda c: F.when(F.col(f"known_{c}.band") == F.col("band"), first_of(F.col(f"known_{c}.{c}"), row, col))
    same = (F.col("known_cell.row") == row) & (F.col("known_cell.col") == col)
    return seen.select(*w.columns, "again", F.col("known_sheet.there").alias("there"), covering("merges")["corner"].alias("corner"), covering("rules").alias("rule"), F.when(same, F.col("known_cell.formula")).alias("formula_now"))


def _with(w: DataFrame, facts: DataFrame, on: list[str], name: str) -> DataFrame:
    """w with a struct ``name`` of what ``facts`` has besides ``on``, else null; of several rows the largest."""
    got = F.struct(*[c for c in facts.columns if c not in on])
    running = Window.partitionBy(*on).orderBy("side").rowsBetween(Window.unboundedPreceding, 0)
    both = _facts(w, facts.select(*on, got.alias("fact")))
    return both.withColumn(name, F.max("fact").over(running)).where("side = 1").select(*w.columns, name)


def checked_writes(writes: DataFrame, live: dict[str, DataFrame], source: DataFrame, dealt: Sequence[int | str] = DEALT) -> DataFrame:
    """Every planned write once, with code (the first gate that it fails, else null), warning, kind, value and again.

    ``writes``: plan, seq, sheet, cell, source (Key[n]), write_policy, preview,
    format_compatible, role_compatible. ``live``, by plan: ``sheets`` (sheet), ``cells``
    (sheet, row, col, text), ``merges`` (sheet, ref), ``validations`` (sheet, ref, n,
    type, operator, formula1, formula2), ``columns`` of the profile (sheet, col,
    value_kind, required). ``source``: plan, source_key, offset, value. The first entry
    of a cell by seq counts; ``again`` tells that there are others.

    All tables are dealt by plan, once: ``dealt`` is what repartition() gets, a number of
    tasks may come first. What comes dealt so is not dealt again, and unions of what is
    dealt alike are dealt so too. The rows of a plan meet in one task and are put in order
    there: joins by sheet, place or source would each deal all writes anew.
    """
    live, source = {k: live[k].repartition(*dealt) for k in LIVE}, source.repartition(*dealt)
    place = parse_a1(F.upper("cell"))
    w = writes.select(*WRITTEN).repartition(*dealt).withColumn("place", place).withColumns({"row": F.col("place.row"), "col": F.col("place.col")}).drop("place")
    out = _of_places(w, live).drop("seq")
    out = _with(out, live["columns"].select("plan", "sheet", "col", "value_kind", F.coalesce("required", F.lit(False)).alias("needed")), ["plan", "sheet", "col"], "column")
    # references are looked up in the plan's own source
    part = lambda i: F.regexp_extract("source", r"^(.*)\[([0-9]+)\]$", i)
    out = out.withColumns({"source_key": part(1), "offset": part(2).try_cast("long")})
    out = _with(out, source.select("plan", "source_key", F.col("offset").cast("long").alias("offset"), F.col("value").alias("raw")), ["plan", "source_key", "offset"], "found")
    out = out.withColumns({"resolved": F.col("found").isNotNull() & F.col("offset").isNotNull(), "raw": F.when(F.col("offset").isNotNull(), F.col("found.raw"))})
    x = infer_source(F.col("raw"))
    out = out.withColumns({"kind": x["kind"], "value": x["value"]})
    corner = (F.col("corner.row") == F.col("row")) & (F.col("corner.col") == F.col("col"))
    rule = lambda c: F.col(f"rule.{c}")
    verdict = F.when(F.col("rule").isNotNull(), check_validation(*[rule(c) for c in ("type", "operator", "formula1", "formula2")], F.col("value")))
    hollow = F.trim(F.coalesce("value", F.lit(""))) == ""
    code = (
        F.when(~F.col("write_policy").eqNullSafe(F.lit("write_value")), "PLAN_INVALID")
        .when(F.col("row").isNull(), "PLAN_INVALID")
        .when(F.col("there").isNull(), "EXECUTION_BLOCKED")
        .when(F.col("corner").isNotNull() & ~F.coalesce(corner, F.lit(False)), "MERGED_CELL_WRITE_FORBIDDEN")
        .when(F.col("formula_now"), "FORMULA_MODIFICATION_FORBIDDEN")
        .when(~F.col("resolved"), "SOURCE_CHANGED")
        .when(F.col("preview").isNotNull() & (F.left(F.coalesce("raw", F.lit("None")), F.lit(PREVIEW)) != F.col("preview")), "SOURCE_CHANGED")
        .when(hollow & F.coalesce("column.needed", F.lit(False)), "EXECUTION_BLOCKED")
        .when(F.col("column").isNull(), "PLAN_INVALID")
        .when((compatible(F.col("kind"), F.col("column.value_kind")) == "mismatch") | ~F.coalesce("format_compatible", F.lit(True)), "TYPE_MISMATCH")
        .when(verdict == "invalid", "VALIDATION_MISMATCH")
    )
    warning = F.when(~F.coalesce("role_compatible", F.lit(True)), "ROLE_MISMATCH_REPORTED").when(verdict == "unsupported", "UNSUPPORTED_VALIDATION")
    return out.select("plan", "sheet", "cell", "row", "col", "source", "kind", "value", code.alias("code"), F.when(code.isNull(), warning).alias("warning"), "again")


def preflight(plans: DataFrame, lists: dict[str, DataFrame], writes: DataFrame, live: dict[str, DataFrame], source: DataFrame, decisions: DataFrame | None = None, dealt: Sequence[int | str] = DEALT) -> DataFrame:
    """plan, code, subject: one row for each blocker of every plan; a plan without rows may go ahead.

    See ``plan_gates``, ``list_gates`` and ``checked_writes`` for what is read;
    ``lists``: blocked, conflicts and unresolved. ``decisions``: plan and decision as
    transactions.idempotency() gives them; a conflict with what the ledger knows blocks,
    and so does a ledger that could not be read (unknown).
    """
    name = F.concat_ws("!", "sheet", "cell")
    told = F.when(F.col("code").isNotNull(), F.struct("code", name.alias("subject")))
    twice = F.when(F.col("again"), F.struct(F.lit("PLAN_INVALID").alias("code"), F.concat(F.lit("duplicate "), name).alias("subject")))
    # a filter by code would be pushed below what it is made of, and every rule of it be written out once more for each mention
    of_writes = checked_writes(writes, live, source, dealt).select("plan", F.explode(F.array(told, twice)).alias("t")).where("t is not null").select("plan", "t.code", "t.subject")
    found = plan_gates(plans).unionByName(list_gates(plans.select("plan", "missing_required", "on_conflict"), lists["blocked"], lists["conflicts"], lists["unresolved"])).unionByName(of_writes)
    if decisions is not None:
        bad = decisions.where(F.col("decision").isin("conflict", "unknown")).select("plan", F.lit("PLAN_CONFLICT").alias("code"), F.col("decision").alias("subject"))
        found = found.unionByName(bad.distinct())
    return found
