"""Regions and headers of sheets: row classes, islands over them, and header scores with evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What a region is as a block and as a row.
BLOCKS = {
    "title": "title_block", "header": "header_block", "subheader": "header_block", "data": "record_block", "subtotal": "subtotal_block", "total": "total_block",
    "notes": "note_block", "section_header": "section_block", "input_region": "input_slot_block",
}
ACCEPT = 55


def row_class(summary, section, notes, formula: str = "formula", nonempty: str = "nonempty"):
    """Class of a row, first reason first: summary, section, notes, a row that is a third formulas or more, data."""
    formulas = (F.col(formula) * 3 >= F.col(nonempty)) & (F.col(nonempty) >= 2)
    return F.when(summary.isNotNull(), summary).when(section, "section_header").when(notes, "notes").when(formulas, "formula_region").otherwise("data")


def regions(rows: DataFrame, keys: list[str], at: str, kind: str) -> DataFrame:
    """Maximal stretches of neighbouring rows of one class: type, first and last row, number, block, and evidence.

    A single formula row belongs to the data before it and ends them. Sections and summaries are regions of one row.
    """
    order = Window.partitionBy(*keys).orderBy(at)
    gap = F.coalesce(F.col(at) - F.lag(at).over(order) > 1, F.lit(True))
    # a lone formula row: neighbours of another class on both sides
    lone = (F.col(kind) == "formula_region") & ~F.coalesce((F.lag(kind).over(order) == "formula_region") & ~F.col("gap"), F.lit(False))
    lone = lone & ~F.coalesce((F.lead(kind).over(order) == "formula_region") & (F.lead(at).over(order) - F.col(at) == 1), F.lit(False))
    marked = rows.withColumn("gap", gap).withColumn("lone", lone).withColumn("type", F.when(F.col("lone"), "data").otherwise(F.col(kind)))
    changed = ~F.col("type").eqNullSafe(F.lag("type").over(order))
    single = F.col("type").isin("section_header", "subtotal", "total")
    new = (F.col("gap") | changed | single | F.coalesce(F.lag("lone").over(order), F.lit(False))).cast("int")
    runs = marked.withColumn("new", new).withColumn("region", F.sum("new").over(order))
    out = runs.groupBy(*keys, "region", "type").agg(F.min(at).alias("first_row"), F.max(at).alias("last_row"), F.count("*").alias("n_rows"), F.count_if("lone").alias("n_lone"))
    table = F.create_map(*[F.lit(x) for kv in BLOCKS.items() for x in kv])
    evidence = F.concat_ws(";", F.concat(F.lit("rows:"), F.col("n_rows").cast("string")), F.when(F.col("n_lone") > 0, "lone_formula_row"))
    return out.select(*keys, "type", "first_row", "last_row", "n_rows", table[F.col("type")].alias("block"), evidence.alias("evidence"))


def header_scores(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """How much each row looks like a header, with reasons; accepted from 55 on.

    ``rows``: keys, at, nonempty, text, num, last_col, n_distinct (labels).
    """
    order = Window.partitionBy(*keys).orderBy(at)
    width = F.max("last_col").over(Window.partitionBy(*keys))
    wide = rows.withColumn("width", width).withColumn("next_num", F.coalesce(F.lead("num").over(order), F.lit(0)))
    signs = {
        "text": (30, (F.col("nonempty") >= 2) & (F.col("text") >= 0.8 * F.col("nonempty"))),
        "filled": (20, F.col("nonempty") >= 0.8 * F.col("width")),
        "types_change": (20, (F.col("num") == 0) & (F.col("next_num") > 0)),
        "unique": (10, (F.col("nonempty") >= 2) & (F.col("n_distinct") == F.col("nonempty"))),
        "early": (8, F.col(at) <= 3),
    }
    score = sum((F.when(c, w).otherwise(0) for w, c in signs.values()), F.lit(0)) - F.when(F.col("nonempty") < 0.5 * F.col("width"), 20).otherwise(0)
    reasons = F.array_compact(F.array(*[F.when(c, n) for n, (_, c) in signs.items()]))
    return wide.select(*keys, at, F.greatest(F.lit(0), score).alias("score"), (score >= ACCEPT).alias("accepted"), F.array_join(F.array_sort(reasons), ";").alias("evidence"))
