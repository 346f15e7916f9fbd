"""Several blocks of new rows at once, in any number of sheets: what cells, formulas and ranges become.

Blocks are applied from the lowest of a sheet up, of those at one row by block. All
of them together are one step function of the row, whose sorted break points carry
running shifts; cells, ends of references and ends of ranges read it as of their
row. The result is what inserting one block after another gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.refs import MAX_ROW
from .restructure import PIECE, REFERENCE, STRETCHED, new_rows, range_bounds, range_text
from .transactions import as_of, within_ranges

#: Rows of a sheet that are read in one ordered pass.
BIN = 1 << 16


def placed(blocks: DataFrame) -> DataFrame:
    """blocks (sheet, block, template_row, insert_at, rows_to_add, c0, c1) that grow, with ``up``: rows that come in above afterwards."""
    order = Window.partitionBy("sheet").orderBy("insert_at", F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.where("rows_to_add > 0").withColumn("up", F.coalesce(F.sum("rows_to_add").over(order), F.lit(0)).cast("int"))


def steps(blocks: DataFrame) -> DataFrame:
    """key (sheet in lower case), bin, at, shift: rows from ``at`` on move down by ``shift``, up to the next step.

    Each bin of a sheet begins with the shift that holds there.
    """
    own = blocks.where("rows_to_add > 0").groupBy(F.lower("sheet").alias("key"), F.col("insert_at").cast("int").alias("at")).agg(F.sum("rows_to_add").alias("n"))
    starts = own.select("key").distinct().select("key", F.explode(F.sequence(F.lit(0), F.lit(2 * MAX_ROW), F.lit(BIN))).alias("at"), F.lit(0).cast("long").alias("n"))
    both = own.unionByName(starts).groupBy("key", "at").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return both.select("key", F.floor(F.col("at") / BIN).alias("bin"), "at", total.cast("int").alias("shift"))


def shift_of(rows: DataFrame, steps_: DataFrame, key: Column, at: str, name: str) -> DataFrame:
    """``rows`` with ``name``: how far row ``at`` of sheet ``key`` moves; null where nothing is inserted in that sheet."""
    marked = rows.withColumns({"key": key, "bin": F.floor(F.col(at) / BIN), "at": F.col(at).cast("int")})
    return as_of(marked, steps_, ["key", "bin"], "at", [], ["shift"]).withColumn(name, F.col("shift")).drop("key", "bin", "at", "at_found", "shift")


def _group(piece: Column, i: int) -> Column:
    return F.regexp_extract(piece, REFERENCE, i)


def rewritten(formulas: DataFrame, steps_: DataFrame, key: list[str]) -> DataFrame:
    """``formulas`` with ``text`` as it is after all insertions; ``key`` tells them apart.

    Columns sheet and text. With ``offset`` (not null) a text is that of block
    ``insert_at``, ``up``, copied down by so many rows when its rows came in:
    references without a dollar sign go down with it, at the time of that block.
    """
    pieces = F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))
    p = F.col("piece")
    name = F.replace(F.regexp_replace(_group(p, 1), "^'|'?!$", ""), F.lit("''"), F.lit("'"))
    refs = formulas.select(*dict.fromkeys([*key, "sheet"]), "insert_at", "up", "offset", F.posexplode(pieces).alias("pos", "piece")).where(p.rlike(REFERENCE))
    refs = refs.withColumn("other", F.when(_group(p, 1) == "", F.col("sheet")).otherwise(name))
    end = lambda i, first: F.when(_group(p, first + 3) != "", F.struct(F.lit(i).alias("end"), _group(p, first).alias("d1"), _group(p, first + 1).alias("letters"), _group(p, first + 2).alias("d2"), _group(p, first + 3).try_cast("int").alias("ref_row")))
    ends = refs.withColumn("x", F.explode(F.filter(F.array(end(0, 2), end(1, 6)), lambda e: e.isNotNull()))).select("*", "x.*").drop("x")
    ends = shift_of(ends, steps_, F.lower("other"), "ref_row", "s1")
    own, before = F.lower("other") == F.lower("sheet"), F.col("other") < F.col("sheet")
    down = F.when(F.col("d2") == "", F.col("offset")).otherwise(0)
    s1, row, at, up = F.coalesce("s1", F.lit(0)), F.col("ref_row"), F.col("insert_at"), F.col("up")
    copied = F.when(own, F.when(row < at, row).otherwise(row + s1 - up)).when(before, row + s1).otherwise(row) + down
    plain = ends.where("offset is null").withColumn("to", row + s1)
    again = shift_of(ends.where("offset is not null").withColumn("mid", copied), steps_, F.lower("other"), "mid", "s2")
    s2, mid = F.coalesce("s2", F.lit(0)), F.col("mid")
    again = again.withColumn("to", F.when(own, F.when(mid >= at, mid + up).otherwise(mid + s2)).when(before, mid).otherwise(mid + s2)).drop("mid", "s2")
    ends = plain.unionByName(again)
    # a reference to a sheet that changes is written with capital letters, whether it moves or not
    letters = F.when(F.col("s1").isNotNull(), F.upper("letters")).otherwise(F.col("letters"))
    text = F.when((F.col("to") >= 1) & (F.col("to") <= MAX_ROW), F.concat("d1", letters, "d2", F.col("to").cast("string")))
    per = ends.groupBy(*key, "pos").agg(F.first(_group(p, 1)).alias("prefix"), F.array_sort(F.collect_list(F.struct("end", text.alias("text")))).alias("ends"))
    joined = F.when(F.exists("ends", lambda e: e["text"].isNull()), F.lit("#REF!")).otherwise(F.array_join(F.transform("ends", lambda e: e["text"]), ":"))
    per = per.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("pos", F.concat("prefix", joined).alias("text")))).alias("new"))
    out = formulas.join(per, key, "left")
    whole = F.array_join(F.transform(pieces, lambda x, i: F.coalesce(F.try_element_at("new", i), x)), "")
    return out.withColumn("text", F.when(F.col("new").isNotNull(), whole).otherwise(F.col("text"))).drop("new")


def grown_ranges(ranges: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row for each range: ``to`` (where it is after all insertions) and ``warning``.

    ``ranges``: sheet, kind, name, ref (one or several, separated by spaces) and
    ``type``, a rule's type or several separated by spaces. A part of a validation
    or conditional format that ends between the template row of a block and its new
    rows and overlaps its columns ends at the last new row; a table or filter does
    if it ends in the template row. Rules of kinds that are not known to be safe
    move like all others but don't grow, and are told. A null or unreadable part
    stays as it is.
    """
    b = placed(blocks)
    safe = F.lit(True)
    for kind, types in STRETCHED.items():
        known = F.forall(F.split(F.coalesce("type", F.lit("")), " "), lambda t: t.isin(types))
        safe = F.when(F.col("kind") == kind, known).otherwise(safe)
    numbered = ranges.withColumn("id", F.xxhash64("sheet", "kind", "name", "ref", "type"))
    parts = numbered.select("id", "sheet", "kind", safe.alias("safe"), F.posexplode(F.split("ref", r"\s+")).alias("pos", "part")).distinct()
    parts = parts.withColumn("r", range_bounds(F.col("part"))).select("*", "r.*").drop("r")
    moved = shift_of(parts, steps(blocks), F.lower("sheet"), "r0", "s0")
    moved = shift_of(moved, steps(blocks), F.lower("sheet"), "r1", "s1")
    # blocks whose template row and first new row have the end between them; the lowest counts, of several at a row the first
    spans = b.select("sheet", "template_row", "insert_at", "rows_to_add", "up", "block", F.col("c0").alias("b0"), F.col("c1").alias("b1"), (F.col("insert_at") - 1).alias("stop")).where("template_row <= stop")
    rule = F.col("kind").isin(*STRETCHED)
    fits = F.when(rule, (F.col("c1") >= F.col("b0")) & (F.col("c0") <= F.col("b1")) & (F.col("r0") <= F.col("template_row"))).otherwise(F.col("r1") == F.col("template_row"))
    hits = within_ranges(parts.where(F.col("kind").isin(*STRETCHED, "table", "autofilter") & F.col("safe")), spans, "r1", "template_row", "stop", ["sheet"]).where(fits)
    last = F.col("insert_at") + F.col("up") + F.col("rows_to_add") - 1
    hits = hits.groupBy("id", "pos").agg(F.min_by(last, F.struct(-F.col("insert_at"), F.col("block"))).alias("last"))
    out = moved.join(hits, ["id", "pos"], "left")
    r1 = F.coalesce("last", F.col("r1") + F.coalesce("s1", F.lit(0)))
    to = F.when(F.col("r0").isNull(), F.col("part")).otherwise(range_text(F.col("c0"), F.col("r0") + F.coalesce("s0", F.lit(0)), F.col("c1"), r1, ~F.col("part").contains(":")))
    per = out.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", to.alias("to")))), lambda x: x["to"]), " ").alias("to"))
    code = F.when(F.col("kind") == "validation", "UNSUPPORTED_VALIDATION_PROPAGATION").otherwise("PRESERVE_WITH_WARNING")
    told = numbered.join(per, "id", "left").join(b.select("sheet").distinct().withColumn("any", F.lit(True)), "sheet", "left")
    return told.select(*ranges.columns, F.coalesce("to", "ref").alias("to"), F.when(~safe & F.col("any").isNotNull(), code).alias("warning"))


def new_merges(merges: DataFrame, blocks: DataFrame) -> DataFrame:
    """sheet and ref of the merges that the new rows get: those of the template row, one row high and inside the block."""
    m = merges.select("sheet", range_bounds(F.col("ref")).alias("m")).where("m.r0 = m.r1").select("sheet", F.col("m.r0").alias("template_row"), F.col("m.c0").alias("m0"), F.col("m.c1").alias("m1"))
    out = new_rows(placed(blocks)).join(m, ["sheet", "template_row"]).where("m0 >= c0 and m1 <= c1")
    row = F.col("at") + F.col("up")
    return out.select("sheet", range_text(F.col("m0"), row, F.col("m1"), row).alias("ref"))


def expand(cells: DataFrame, ranges: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, ranges) after all ``blocks`` have grown.

    ``cells``: sheet, row, col, text and what else they carry. Those of new rows are
    the template row's inside the block's columns, formulas copied down and values
    left out. ``ranges``: sheet, kind, name, ref, type; merges of the new rows are
    added, names (kind defined_name) are rewritten like formulas. No block changes
    nothing; a null text is an empty cell and stays one.
    """
    b, s = placed(blocks), steps(blocks)
    none = F.lit(None).cast("int")
    old = cells.withColumns({"insert_at": none, "up": none, "offset": none})
    at = F.col("at")
    added = new_rows(b).join(cells.withColumnRenamed("row", "template_row"), ["sheet", "template_row"]).where("col between c0 and c1")
    added = added.withColumn("text", F.when(F.startswith("text", F.lit("=")), F.col("text"))).withColumn("row", at)
    every = old.unionByName(added.select(*old.columns))
    is_formula = F.coalesce(F.startswith("text", F.lit("=")), F.lit(False))
    key = ["sheet", "row", "col", "offset_", "insert_at_"]
    marked = every.withColumns({"offset_": F.coalesce("offset", F.lit(0)), "insert_at_": F.coalesce("insert_at", F.lit(0))})
    texts = rewritten(marked.where(is_formula), s, key)
    done = marked.where(~is_formula).unionByName(texts)
    done = shift_of(done, s, F.lower("sheet"), "row", "by")
    row = F.when(F.col("offset").isNotNull(), F.col("row") + F.col("up")).otherwise(F.col("row") + F.coalesce("by", F.lit(0)))
    out = done.withColumn("row", row.cast(dict(cells.dtypes)["row"])).select(*cells.columns)
    grown = grown_ranges(ranges.where("kind <> 'defined_name'"), blocks).select(*[F.col("to").alias("ref") if c == "ref" else F.col(c) for c in ranges.columns])
    names = ranges.where("kind = 'defined_name'").withColumn("text", F.col("ref")).withColumns({"insert_at": none, "up": none, "offset": none})
    names = rewritten(names, s, ["sheet", "name", "ref"]).withColumn("ref", F.col("text")).select(*ranges.columns)
    merges = new_merges(ranges.where("kind = 'merge'"), blocks).withColumns({c: F.lit("merge") if c == "kind" else F.lit(None).cast(t) for c, t in ranges.dtypes if c not in ("sheet", "ref")})
    return out, grown.unionByName(names).unionByName(merges.select(*ranges.columns))
