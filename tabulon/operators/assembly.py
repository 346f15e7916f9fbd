"""What a sheet is made of, put together from its rows: spans, titles, header signatures, regions of columns, types, blocks and targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.infer import rollup_type
from ..functions.refs import index_to_col
from ..functions.text import SUBTOTAL_WORDS, TOTAL_WORDS, normalize_header, summary_label
from .filling import bounded
from .restructure import range_text
from .sequence import bands
from .structure import BLOCKS
from .transactions import within_ranges

# Kinds by the letters of a row's signature, and the archetype of a region's rows.
LETTERS = {"t": "string", "i": "integer", "n": "decimal", "d": "datetime", "b": "boolean", "q": "formula", "x": "string"}
ROWS = {
    "header": "header_row", "subheader": "header_row", "data": "record_row", "subtotal": "subtotal_row", "total": "total_row", "notes": "note_row", "input_region": "input_slot_row",
    "section_header": "section_row", "title": "title_row",
}


def _table(values: dict, key: Column, default: str | None = None) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)
    return found if default is None else F.coalesce(found, F.lit(default))


# -------------------------------------------------------------------------- rows


def summary_kind(label: Column, formulas: Column) -> Column:
    """total or subtotal for a row's normalised first label: the exact word, or such a beginning beside a formula."""
    exact = label.isin([*TOTAL_WORDS, *SUBTOTAL_WORDS])
    return F.when(exact | (formulas > 0), summary_label(label))


def is_title_prefix(nonempty: Column, text: Column, formula: Column, bold: Column, first: Column, width: Column) -> Column:
    """A line of one or two texts over less than half the width, bold or in capitals, glued to what is below."""
    upper = (F.upper(first) == first) & (F.lower(first) != first)
    return F.coalesce(nonempty.between(1, 2) & (formula == 0) & (text == nonempty) & (nonempty * 2 < width) & first.isNotNull() & ((bold >= 1) | upper), F.lit(False))


def is_sparse(signature: Column) -> Column:
    """More than three fifths of a row's signature are empty."""
    return F.coalesce(F.length(F.regexp_replace(signature, r"[^.]", "")) * 5 > F.length(signature) * 3, F.lit(True)) | (signature == "")


def spans(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges (sheet, first_row, last_row, ...) with width, min_col, max_col and ref: what their rows use. ``rows``: sheet, row, first_col, last_col."""
    keys = ranges.columns
    inside = within_ranges(rows.select("sheet", "row", "first_col", "last_col"), ranges, "row", "first_row", "last_row", ["sheet"])
    used = inside.groupBy(*keys).agg(F.min("first_col").alias("min_col"), F.max("last_col").alias("max_col"))
    out = ranges.join(used, keys, "left").withColumn("width", F.coalesce("max_col", F.lit(0)))
    return out.withColumn("ref", F.when(F.col("min_col").isNotNull(), range_text(F.col("min_col"), F.col("first_row"), F.col("max_col"), F.col("last_row"))))


def title_bands(rows: DataFrame, gap: int = 0) -> DataFrame:
    """sheet, start, end: the first band of each sheet, where it is a title: two rows at most with one or two cells each, and another band below."""
    found = bands(rows.where("nonempty > 0"), ["sheet"], "row", gap)
    order = Window.partitionBy("sheet").orderBy("start")
    first = found.withColumn("k", F.row_number().over(order)).withColumn("more", F.lead("start").over(order).isNotNull()).where("k = 1 and more and end - start < 2")
    crowded = within_ranges(rows, first.select("sheet", "start", "end"), "row", "start", "end", ["sheet"]).groupBy("sheet").agg(F.max("nonempty").alias("most"))
    return first.join(crowded, "sheet").where("most <= 2").select("sheet", "start", "end")


def header_signatures(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """sheet, first_row, col, label: what the rows of each header say of each column, joined and normalised."""
    inside = within_ranges(cells.where("text is not null").select("sheet", "row", "col", "text"), headers.select("sheet", "first_row", "last_row"), "row", "first_row", "last_row", ["sheet"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda x: x["text"])
    return inside.groupBy("sheet", "first_row", "col").agg(normalize_header(F.array_join(parts, " | ")).alias("label"))


def styled_regions(rows: DataFrame) -> DataFrame:
    """sheet, type, first_row, last_row, ref, styled: runs of rows that hold styles and no values. ``rows``: nonempty, styled, styled_min, styled_max."""
    empty = rows.where("nonempty = 0 and styled > 0")
    found = bands(empty, ["sheet"], "row").select("sheet", F.col("start").alias("first_row"), F.col("end").alias("last_row"))
    inside = within_ranges(empty, found, "row", "first_row", "last_row", ["sheet"])
    per = inside.groupBy("sheet", "first_row", "last_row").agg(F.sum("styled").alias("styled"), F.min("styled_min").alias("a"), F.max("styled_max").alias("b"))
    return per.select("sheet", F.lit("input_region").alias("type"), "first_row", "last_row", range_text(F.col("a"), F.col("first_row"), F.col("b"), F.col("last_row")).alias("ref"), "styled")


# ----------------------------------------------------------------------- columns


def column_regions(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """sheet, col, region: the type of region that covers most of a column's rows, the earlier one of equals."""
    r = regions.select("sheet", "type", "first_row", "last_row")
    inside = within_ranges(rows.where("first_col is not null").select("sheet", "row", "first_col", "last_col"), r, "row", "first_row", "last_row", ["sheet"])
    # counted by span first: many rows use the same columns
    by_span = inside.groupBy("sheet", "type", "first_col", "last_col").agg(F.count("*").alias("n"), F.min("first_row").alias("at"))
    per = by_span.withColumn("col", F.explode(F.sequence("first_col", "last_col"))).groupBy("sheet", "col", "type").agg(F.sum("n").alias("n"), F.min("at").alias("at"))
    return per.groupBy("sheet", "col").agg(F.min_by("type", F.struct(-F.col("n"), F.col("at"))).alias("region"))


def body_types(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """sheet, col, type: the type of each column without its header rows, from the rows' signatures."""
    marked = within_ranges(rows.select("sheet", "row"), headers.select("sheet", "first_row", "last_row"), "row", "first_row", "last_row", ["sheet"]).select("sheet", "row").distinct()
    body = rows.join(marked, ["sheet", "row"], "left_anti").groupBy("sheet", "sig").agg(F.count("*").alias("n"))
    letters = body.select("sheet", F.posexplode(F.split("sig", "")).alias("i", "letter")).where("letter <> '.' and letter <> ''")
    kind = _table(LETTERS, F.col("letter"))
    return letters.groupBy("sheet", (F.col("i") + 1).alias("col")).agg(rollup_type(F.array_sort(F.collect_set(kind))).alias("type"))


def dimensions(rows: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """sheet, used_range, true_max_row, true_max_column and, beside declared dimensions (sheet, max_row, max_col), by how much those exceed them."""
    full = F.col("nonempty") > 0
    per = rows.groupBy("sheet").agg(F.min(F.when(full, F.col("row"))).alias("r0"), F.max(F.when(full, F.col("row"))).alias("r1"), F.min("first_col").alias("c0"), F.max("last_col").alias("c1"))
    used = F.when(F.col("r1").isNotNull(), range_text(F.col("c0"), F.col("r0"), F.col("c1"), F.col("r1")))
    out = per.select("sheet", used.alias("used_range"), F.col("r1").alias("true_max_row"), F.col("c1").alias("true_max_column"))
    if declared is None:
        return out
    over = lambda a, b: F.greatest(F.lit(0), F.col(a) - F.coalesce(b, F.lit(0)))
    both = declared.select("sheet", "max_row", "max_col").join(out, "sheet", "left")
    return both.withColumn("inflation_rows", over("max_row", "true_max_row")).withColumn("inflation_columns", over("max_col", "true_max_column")).drop("max_row", "max_col")


def locale(formats: DataFrame) -> DataFrame:
    """guess (comma, point or null), comma and point: what the number formats of columns show of the decimal separator. ``formats``: number_format."""
    bare = F.regexp_replace("number_format", r'"[^"]*"|\\.|\[[^\]]*\]', "")
    kinds = formats.where("number_format is not null").select("number_format", bare.alias("f")).distinct()
    votes = kinds.agg(F.count_if(F.col("f").contains("0,0")).alias("comma"), F.count_if(F.col("f").contains("0.0")).alias("point"))
    return votes.select(F.when(F.col("comma") > F.col("point"), "comma").when(F.col("point") > F.col("comma"), "point").alias("guess"), "comma", "point")


def shows_dates(fmt: Column) -> Column:
    """Whether a number format shows dates or times: quoted, escaped and bracketed parts don't count, and a # rules it out."""
    bare = F.regexp_replace(F.lower(F.coalesce(fmt, F.lit(""))), r'"[^"]*"|\\.|\[[^\]]*\]', "")
    return bare.rlike("[ydhs]") & ~bare.contains("#")


def locale_patterns(formats: DataFrame, most: int = 5) -> DataFrame:
    """format, n, is_date and rank of the number formats of columns, the most frequent first: the first ``most``, and all that show dates."""
    counts = formats.where("number_format <> ''").groupBy(F.col("number_format").alias("format")).agg(F.count("*").alias("n"))
    # as many rows as there are different formats
    ranked = counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "format")))
    return ranked.withColumn("is_date", shows_dates(F.col("format"))).where((F.col("rank") <= most) | F.col("is_date"))


def blank_columns(columns: DataFrame, material: Column) -> DataFrame:
    """sheet, n_columns, n_blank: how many columns say nothing (see semantics.is_material): they are counted, never dropped unsaid."""
    return columns.groupBy("sheet").agg(F.count("*").alias("n_columns"), F.count_if(~material).alias("n_blank"))


# ------------------------------------------------------------------------ counts


def sheet_counts(cells: DataFrame, structure: DataFrame) -> DataFrame:
    """sheet, max_row, max_col, formulas, cached (formulas with a value), and how many tables, merges, validations and conditional formats there are."""
    formula = F.col("kind") == "formula"
    per = cells.groupBy("sheet").agg(F.max("row").alias("max_row"), F.max("col").alias("max_col"), F.count_if(formula).alias("formulas"), F.count_if(formula & F.col("cached").isNotNull()).alias("cached"))
    kinds = ["table", "merge", "validation", "conditional_format"]
    counts = structure.groupBy("sheet").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in kinds])
    return per.join(counts, "sheet", "full").na.fill(0, ["formulas", "cached", *[f"{k}s" for k in kinds]])


def identity(**parts: Column) -> Column:
    """SHA-256 of named parts as JSON, names in order: equal parts give equal identities, whatever order they are given in."""
    return F.sha2(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]), {"ignoreNullFields": "false"}), 256)


def structure_fingerprint(parts: DataFrame, keys: list[str], part: str) -> DataFrame:
    """keys and fingerprint of each group's parts (name|dimensions|tables of its sheets), in whatever order they come."""
    text = F.array_join(F.array_sort(F.collect_list(part)), "\x1f")
    return parts.groupBy(*keys).agg(F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("fingerprint"))


# --------------------------------------------------------------- blocks and targets


def blocks(regions: DataFrame, keys: DataFrame) -> DataFrame:
    """Blocks of a sheet in order: block_id, archetype, row_archetype, and for record blocks the best key candidate.

    ``regions``: sheet, type, first_row, last_row, ref; ``keys``: sheet, col, score,
    duplicates (see semantics.key_score). Of equal scores the first column counts;
    ``requires_review`` where the next one is within ten.
    """
    order = Window.partitionBy("sheet").orderBy("first_row", "last_row")
    found = regions.withColumn("block_id", F.concat(F.lit("b"), F.row_number().over(order).cast("string"))).withColumn("archetype", _table(BLOCKS, F.col("type"), "unclassified_block")).withColumn("row_archetype", _table(ROWS, F.col("type"), "unknown_row"))
    columns = bounded(found.where("archetype = 'record_block'")).select("sheet", "block_id", F.explode(F.sequence("c0", "c1")).alias("col"))
    ranked = Window.partitionBy("sheet", "block_id").orderBy(F.desc("score"), "col")
    best = columns.join(keys, ["sheet", "col"]).withColumn("k", F.row_number().over(ranked)).withColumn("second", F.lead("score").over(ranked)).where("k = 1")
    best = best.select("sheet", "block_id", F.col("col").alias("key_col"), F.col("score").alias("key_score"), F.col("duplicates").alias("key_duplicates"), F.coalesce(F.col("score") - F.col("second") < 10, F.lit(False)).alias("requires_review"))
    return found.join(best, ["sheet", "block_id"], "left")


def targets(columns: DataFrame, blocks_: DataFrame, slots: DataFrame) -> DataFrame:
    """columns with mode, anchor_row, block_id and slot: where a fill would begin in each.

    Inside a record block rows are filled from its first one; a slot of several rows
    is a block of rows, one of a single row a scalar; without either there is no anchor.
    """
    inside = bounded(blocks_.where("archetype = 'record_block'")).select("sheet", F.explode(F.sequence("c0", "c1")).alias("col"), "block_id", F.col("first_row").alias("block_row"))
    inside = inside.groupBy("sheet", "col").agg(F.max_by(F.struct("block_id", "block_row"), "block_row").alias("b"))
    known = bounded(slots.where("ref is not null")).select("sheet", F.explode(F.sequence("c0", "c1")).alias("col"), "ref", "r0", "r1")
    known = known.groupBy("sheet", "col").agg(F.max_by(F.struct("ref", "r0", "r1"), "r0").alias("s"))
    out = columns.join(inside, ["sheet", "col"], "left").join(known, ["sheet", "col"], "left")
    block = F.col("b").isNotNull() | (F.col("s.r1") > F.col("s.r0"))
    return out.select(*columns.columns, index_to_col(F.col("col")).alias("letter"), F.when(F.coalesce(block, F.lit(False)), "row_block").otherwise("scalar").alias("mode"), F.coalesce("b.block_row", "s.r0").alias("anchor_row"), F.col("b.block_id").alias("block_id"), F.col("s.ref").alias("slot"))


def located(wanted: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """wanted with what a profile knows of it and ``found``: blocks by sheet and block_id, columns by sheet and letter.

    Each row of wanted stays once; of several known rows with one key the least counts. A null key is not found.
    """
    rest = [c for c in known.columns if c not in keys]
    one = known.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("x")).select(*keys, F.lit(True).alias("found"), "x.*")
    return wanted.join(one, keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def newest(ledger: DataFrame, plan: str, region: str | None = None) -> DataFrame:
    """The newest committed record of a plan, and of a region if one is given, by ``seq``: one row or none."""
    own = ledger.where((F.col("status") == "committed") & (F.col("plan") == plan))
    own = own if region is None else own.where(F.col("region") == region)
    return own.orderBy(F.desc("seq")).limit(1)
