"""The match report: a template's sheets against those of an instance, then columns and regions inside, with all that is left over.

Every part is a relation by ``match`` (a template and an instance) and sheet. Work is
on sheets, columns and regions, never on rows of data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.rounds import stored
from . import matching as M
from .semantics import MARGIN, level


def pair_sheets(template: DataFrame, instance: DataFrame, t_columns: DataFrame, i_columns: DataFrame) -> DataFrame:
    """match, t_sheet, i_sheet (null: none), how (name, headers or null) and overlap: each sheet used once.

    ``template``, ``instance``: match, sheet, pos (its place in the workbook);
    ``t_columns``, ``i_columns``: match, sheet, norm. Sheets of one name are paired
    first; each other one, in order, with the free one that shares most headers, the
    first of several, if it shares any. Of sheets that share a name in one workbook
    the first counts.
    """
    t = template.groupBy("match", "sheet").agg(F.min("pos").alias("t_pos"))
    i = instance.groupBy("match", "sheet").agg(F.min("pos").alias("i_pos"))
    named = t.join(i, ["match", "sheet"])
    rest_t, rest_i = t.join(named, ["match", "sheet"], "left_anti"), i.join(named, ["match", "sheet"], "left_anti")
    headers = lambda c, rest: c.join(rest, ["match", "sheet"]).where("norm is not null").select("match", "norm", *[x for x in rest.columns if x.endswith("_pos")]).distinct()
    shared = headers(t_columns, rest_t).join(headers(i_columns, rest_i), ["match", "norm"]).groupBy("match", "t_pos", "i_pos").agg(F.count("*").cast("int").alias("score"))
    best = M.greedy(shared, "match", "t_pos", "i_pos", least=1).where("i_pos is not null").select("match", "t_pos", "i_pos", F.col("score").alias("overlap"))
    by_headers = rest_t.join(best, ["match", "t_pos"], "left").join(rest_i.select("match", "i_pos", F.col("sheet").alias("i_sheet")), ["match", "i_pos"], "left")
    by_headers = by_headers.select("match", F.col("sheet").alias("t_sheet"), "i_sheet", F.when(F.col("i_sheet").isNotNull(), "headers").alias("how"), "overlap")
    by_name = named.select("match", F.col("sheet").alias("t_sheet"), F.col("sheet").alias("i_sheet"), F.lit("name").alias("how"), F.lit(None).cast("int").alias("overlap"))
    return by_name.unionByName(by_headers)


@dataclass
class MatchReport:
    """sheets: a row for each template sheet with scores and what speaks for a review; columns and regions: every template one with its match, or why there is none; extras: what the instance has alone; conflicts; overall: a row for each match."""

    sheets: DataFrame
    columns: DataFrame
    regions: DataFrame
    extras: DataFrame
    conflicts: DataFrame
    overall: DataFrame


def _side(rows: DataFrame, pairs: DataFrame, which: str) -> DataFrame:
    """``rows`` of paired sheets, by pair: match and template sheet in one key."""
    own = pairs.where("i_sheet is not null").select("match", "t_sheet", F.col(which).alias("sheet"))
    return rows.join(own, ["match", "sheet"]).withColumn("pair", F.to_json(F.struct("match", "t_sheet")))


def match_report(template: dict[str, DataFrame], instance: dict[str, DataFrame], store=stored) -> MatchReport:
    """Match every template with its instance.

    Parts that the relations share are written by ``store`` and read back: they are
    of the size of layouts.

    Both sides: ``sheets`` (match, sheet, pos, kinds: formulas by kind, and the parts
    that structural_score reads), ``columns`` (match, sheet, col, norm, role, type,
    number_format) and ``regions`` (match, sheet, region, type, first_row, last_row).
    A sheet without a counterpart scores 0 and asks for a review, as a pair does in
    which some column or region has a runner-up within MARGIN. No template sheet, no rows.
    """
    pairs = store(pair_sheets(template["sheets"], instance["sheets"], template["columns"], instance["columns"]))
    t_cols, i_cols = _side(template["columns"], pairs, "t_sheet"), _side(instance["columns"], pairs, "i_sheet")
    scores = store(M.pair_scores(t_cols, i_cols))
    none = t_cols.select("pair", F.col("col").alias("t_col"), F.lit(-1).alias("i_col"), F.lit(-1).alias("score"))
    got = store(M.greedy(scores.unionByName(none), least=M.LEAST))
    # what a column reached at most, for those that nothing was near enough
    best = scores.groupBy("pair", "t_col").agg(F.max("score").alias("best_score"))
    close = F.coalesce((F.col("second_score") >= 0) & (F.col("score") - F.col("second_score") < MARGIN), F.lit(False))
    second = F.when(F.col("second_score") >= 0, F.col("second_score")).alias("second_score")
    key = t_cols.select("pair", "match", "t_sheet", F.col("col").alias("t_col"), F.col("norm").alias("t_norm"), F.col("type").alias("t_type"), F.col("number_format").alias("t_format"))
    other = i_cols.select("pair", F.col("col").alias("i_col"), F.col("sheet").alias("i_sheet"), F.col("norm").alias("i_norm"), F.col("type").alias("i_type"), F.col("number_format").alias("i_format"))
    matched = got.select("pair", "t_col", "i_col", "score", second, level(F.col("score")).alias("level"), close.alias("requires_review")).join(best, ["pair", "t_col"], "left")
    matched = store(key.join(matched, ["pair", "t_col"]).join(other, ["pair", "i_col"], "left"))
    reason = F.when(F.col("i_col").isNull(), F.lit(f"no instance column reached the minimum match score {M.LEAST}"))
    columns = matched.select("match", "t_sheet", "i_sheet", "t_col", "i_col", "score", "second_score", F.when(F.col("i_col").isNotNull(), F.col("level")).alias("level"), "requires_review", reason.alias("reason"), F.when(F.col("i_col").isNull(), F.coalesce("best_score", F.lit(0))).alias("best_score"))

    both = matched.where("i_col is not null")
    conflict = lambda kind, a, b, differs: both.where(differs).select("match", "t_sheet", "t_col", "i_col", F.lit(kind).alias("kind"), F.col(a).alias("template"), F.col(b).alias("instance"))
    filled = (F.col("t_type") != "") & (F.col("i_type") != "") & (F.col("t_type") != F.col("i_type"))
    conflicts = conflict("value_kind", "t_type", "i_type", filled).unionByName(conflict("number_format", "t_format", "i_format", ~F.col("t_format").eqNullSafe(F.col("i_format"))))

    t_regions, i_regions = _side(template["regions"], pairs, "t_sheet"), _side(instance["regions"], pairs, "i_sheet")
    near = store(M.match_regions(t_regions, i_regions))
    real = F.col("i_region") >= 0
    placed = near.select("pair", "t_region", F.when(real, F.col("i_region")).alias("i_region"), F.when(real, F.col("score")).alias("score"), (F.coalesce(real, F.lit(False)) & close).alias("requires_review"))
    regions = t_regions.select("pair", "match", "t_sheet", F.col("region").alias("t_region"), "type").join(placed, ["pair", "t_region"])
    regions = regions.withColumn("reason", F.when(F.col("i_region").isNull(), "no instance region of this type"))

    left = lambda rows, taken, number, c: rows.select("pair", "match", "sheet", F.col(number).alias(c)).join(taken.where(f"{c} is not null").select("pair", c), ["pair", c], "left_anti")
    extra_columns = left(i_cols, got.where("i_col >= 0"), "col", "i_col").select("match", F.col("sheet").alias("i_sheet"), F.lit("column").alias("kind"), F.col("i_col").alias("number"))
    extra_regions = left(i_regions, placed, "region", "i_region").select("match", F.col("sheet").alias("i_sheet"), F.lit("region").alias("kind"), F.col("i_region").alias("number"))
    used = pairs.where("i_sheet is not null").select("match", F.col("i_sheet").alias("sheet"))
    extra_sheets = instance["sheets"].join(used, ["match", "sheet"], "left_anti").select("match", F.col("sheet").alias("i_sheet"), F.lit("sheet").alias("kind"), F.lit(None).cast("int").alias("number"))
    extras = extra_columns.unionByName(extra_regions).unionByName(extra_sheets)

    share = lambda n, of: F.when(F.coalesce(of, F.lit(0)) == 0, 100).otherwise(F.floor(100 * n / of)).cast("int")
    count = lambda rows, taken, c: rows.groupBy("match", "t_sheet").agg(F.count("*").alias(f"n_{c}"), F.count(taken).alias(f"{c}"), F.bool_or("requires_review").alias(f"{c}_review"))
    per = pairs.join(count(columns, "i_col", "columns"), ["match", "t_sheet"], "left").join(count(regions, "i_region", "regions"), ["match", "t_sheet"], "left")
    t_sheets, i_sheets = _side(template["sheets"], pairs, "t_sheet"), _side(instance["sheets"], pairs, "i_sheet")
    structure = M.structural_score(t_sheets, i_sheets).withColumnRenamed("score", "structural_score")
    kinds = t_sheets.select("pair", "match", "t_sheet", F.col("kinds").alias("a")).join(i_sheets.select("pair", F.col("kinds").alias("b")), "pair")
    kinds = kinds.select("pair", "match", "t_sheet", M.histogram_similarity(F.col("a"), F.col("b")).alias("formula_score")).join(structure, "pair").drop("pair")
    per = per.join(kinds, ["match", "t_sheet"], "left").withColumns({"column_score": share(F.col("columns"), F.col("n_columns")), "region_score": share(F.col("regions"), F.col("n_regions"))})
    there = F.col("i_sheet").isNotNull()
    score = F.when(there, M.sheet_score(F.col("column_score"), F.col("region_score"), F.col("structural_score"), F.col("formula_score"))).otherwise(0)
    part = lambda c: F.when(there, F.col(c)).otherwise(0).alias(c)
    per = per.withColumn("pair_score", score)
    review = ~there | F.coalesce("columns_review", F.lit(False)) | F.coalesce("regions_review", F.lit(False))
    sheets = per.select("match", "t_sheet", "i_sheet", "how", *[part(c) for c in ("region_score", "column_score", "formula_score", "structural_score")], "pair_score", level(F.col("pair_score")).alias("pair_level"), review.alias("requires_review"))
    mean = lambda c: F.floor(F.sum(c) / F.count("*")).cast("int").alias(c)
    overall = sheets.groupBy("match").agg(*[mean(c) for c in ("region_score", "column_score", "formula_score", "structural_score")], F.bround(F.sum("pair_score") / F.count("*"), 0).cast("int").alias("overall_score"), F.count("*").alias("n_sheets"), F.count_if(F.col("i_sheet").isNull()).alias("n_unmatched"), F.bool_or("requires_review").alias("requires_review"))
    return MatchReport(sheets, columns, regions, extras, conflicts, overall.withColumn("overall_level", level(F.col("overall_score"))))
