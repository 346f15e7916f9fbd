"""Matching one layout against another: scores, greedy assignment, rivals, review."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.refs import interval_similarity

# Weights of a column pair, of a source/target pair, and the least score of a match.
COLUMN_WEIGHTS = {"header": 55, "role": 25, "kind": 12, "format": 8, "letter": 5}
SOURCE_WEIGHTS = {"header": 55, "tokens": 30, "role": 25, "kind": 12, "unit": 8, "required": 5}
SHEET_WEIGHTS = {"column": 0.40, "region": 0.25, "structure": 0.20, "formula": 0.15}
LEAST = 30


def pair_scores(template: DataFrame, instance: DataFrame, on: str = "pair") -> DataFrame:
    """Scores of all column pairs within each sheet pair: as many as columns times columns, never rows.

    Both sides: pair, col, norm, role, type, number_format. A header, role or kind that
    is missing or empty agrees with nothing; two missing formats agree.
    """
    names = ("col", "norm", "role", "type", "number_format")
    t = template.select(on, *[F.col(c).alias(f"t_{c}") for c in names])
    i = instance.select(on, *[F.col(c).alias(f"i_{c}") for c in names])
    w = COLUMN_WEIGHTS
    same = lambda c: F.col(f"t_{c}").eqNullSafe(F.col(f"i_{c}")).cast("int")
    known = lambda c: F.coalesce((F.col(f"t_{c}") == F.col(f"i_{c}")) & (F.col(f"t_{c}") != ""), F.lit(False)).cast("int")
    score = known("norm") * w["header"] + known("role") * w["role"] + known("type") * w["kind"] + same("number_format") * w["format"] + same("col") * w["letter"]
    return t.join(i, on).select(on, "t_col", "i_col", F.least(F.lit(100), score).alias("score"))


def greedy(scores: DataFrame, on: str = "pair", first: str = "t_col", second: str = "i_col", least: int = LEAST) -> DataFrame:
    """In order of ``first``, each takes its best free ``second``; ties to the smaller one; below ``least`` none.

    The order matters, so one sheet pair is worked through in one piece; it holds columns, not rows.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        free, out = set(pdf[second]), []
        for t, own in pdf.sort_values([first, "score", second], ascending=[True, False, True]).groupby(first, sort=True):
            own = own[own[second].isin(free)]
            best = own.iloc[0] if len(own) and own.iloc[0]["score"] >= least else None
            runner_up = int(own.iloc[1]["score"]) if best is not None and len(own) > 1 else None
            if best is not None:
                free.discard(best[second])
            out.append((key[0], int(t), None if best is None else int(best[second]), None if best is None else int(best["score"]), runner_up))
        return pd.DataFrame(out, columns=[on, first, second, "score", "second_score"]).astype(object)

    return scores.groupBy(on).applyInPandas(run, f"{on} string, {first} int, {second} int, score int, second_score int")


def rivals(scores: DataFrame, matched: DataFrame, on: str = "pair", margin: int = 10) -> DataFrame:
    """Other template columns that score within ``margin`` of an accepted pair for the same instance column."""
    m = matched.where("i_col is not null").select(on, F.col("t_col").alias("owner"), "i_col", F.col("score").alias("own_score"))
    near = (F.col("t_col") != F.col("owner")) & (F.col("own_score") - F.col("score") < margin)
    return scores.join(m, [on, "i_col"]).where(near).select(on, "i_col", "owner", F.col("t_col").alias("rival"), F.col("score").alias("rival_score"))


def source_scores(source: DataFrame, target: DataFrame) -> DataFrame:
    """Source columns against target columns: header equal or by shared words, role, kind, unit, required."""
    w = SOURCE_WEIGHTS
    s = source.select(*[F.col(c).alias(f"s_{c}") for c in ("col", "norm", "role", "type", "unit")])
    t = target.select(*[F.col(c).alias(f"t_{c}") for c in ("col", "norm", "role", "type", "unit", "required")])
    a, b = F.split("s_norm", " "), F.split("t_norm", " ")
    words = F.floor(w["tokens"] * F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))
    score = (
        F.when(F.col("s_norm") == F.col("t_norm"), w["header"]).otherwise(words)
        + F.when((F.col("s_role") == F.col("t_role")) & (F.col("s_role") != "unknown"), w["role"]).otherwise(0)
        + F.when(F.col("s_type") == F.col("t_type"), w["kind"]).otherwise(0)
        + F.when(F.col("s_unit") == F.col("t_unit"), w["unit"]).otherwise(0)
        + F.when(F.col("t_required"), w["required"]).otherwise(0)
    )
    return s.join(t, F.lit(True)).select("s_col", "t_col", F.least(F.lit(100), score).cast("int").alias("score"))


def region_scores(template: DataFrame, instance: DataFrame, on: str = "pair") -> DataFrame:
    """How alike regions of one type lie: pair, type, t_region, i_region, score. Both sides: pair, region (its number), type, first_row, last_row."""
    t = template.select(on, "type", F.col("region").alias("t_region"), F.col("first_row").alias("a0"), F.col("last_row").alias("a1"))
    i = instance.select(on, "type", F.col("region").alias("i_region"), F.col("first_row").alias("b0"), F.col("last_row").alias("b1"))
    score = interval_similarity(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1"))
    return t.join(i, [on, "type"]).select(on, "type", "t_region", "i_region", score.alias("score"))


def match_regions(template: DataFrame, instance: DataFrame, on: str = "pair") -> DataFrame:
    """Regions in the template's order, each with its best free one of the same type; any score will do, null if none is left."""
    every = template.select(on, F.col("region").alias("t_region"), F.lit(-1).alias("i_region"), F.lit(-1).alias("score"))
    scores = region_scores(template, instance, on).select(on, "t_region", "i_region", "score").unionByName(every)
    return greedy(scores, on, "t_region", "i_region", least=0)


def structural_score(t: DataFrame, i: DataFrame, on: str = "pair") -> DataFrame:
    """pair, score: the mean over six parts of two layouts, rounded down.

    Both sides: pair, merges, tables, validations (arrays of texts), freeze, filter,
    hidden (texts). Merges count by their share in common, tables and validations 100
    or 50, freeze and filter 100 or 60, what is hidden 100 or 70.
    """
    a, b = t.select(on, F.struct("merges", "tables", "validations", "freeze", "filter", "hidden").alias("a")), i.select(on, F.struct("merges", "tables", "validations", "freeze", "filter", "hidden").alias("b"))
    every = F.size(F.array_union("a.merges", "b.merges"))
    shared = F.when(every > 0, F.floor(100 * F.size(F.array_intersect("a.merges", "b.merges")) / every)).otherwise(100)
    equal = lambda c, low: F.when(c, 100).otherwise(low)
    lists = [equal(F.array_sort(f"a.{c}") == F.array_sort(f"b.{c}"), 50) for c in ("tables", "validations")]
    plain = [equal(F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), low) for c, low in (("freeze", 60), ("filter", 60), ("hidden", 70))]
    return a.join(b, on).select(on, F.floor(sum([*lists, *plain], shared) / 6).cast("int").alias("score"))


def sheet_score(column: Column, region: Column, structure: Column, formula: Column) -> Column:
    """Weighted score of a pair of sheets, halves to the even number."""
    w = SHEET_WEIGHTS
    return F.bround(column * w["column"] + region * w["region"] + structure * w["structure"] + formula * w["formula"], 0).cast("int")


def review_subjects(report: DataFrame) -> DataFrame:
    """Subjects kind|subject that a person has to look at, each once; ``report``: kind, subject, requires_review."""
    return report.where("requires_review").select(F.concat_ws("|", "kind", "subject").alias("subject")).distinct()


def histogram_similarity(left: Column, right: Column) -> Column:
    """100 less the share in which two maps of counts differ; two empty maps are alike."""
    diff = F.aggregate(F.map_values(F.map_zip_with(left, right, lambda _, a, b: F.abs(F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0))))), F.lit(0).cast("long"), lambda x, y: x + y)
    total = F.aggregate(F.concat(F.map_values(left), F.map_values(right)), F.lit(0).cast("long"), lambda x, y: x + y)
    return F.when(total == 0, 100).otherwise(100 - F.floor(100 * diff / total)).cast("int")


def review_state(subjects: DataFrame, decisions: DataFrame, on: str) -> DataFrame:
    """Decisions laid over subjects: a decision never changes a score; none counts as pending."""
    known = decisions.where(F.col("state").isin("accepted", "rejected", "pending"))
    return subjects.join(known, on, "left").withColumn("state", F.coalesce("state", F.lit("pending")))
