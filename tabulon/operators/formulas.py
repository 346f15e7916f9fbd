"""Families of formulas, their windows and the dependency graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formulas import intent, parse_formula
from .sequence import runs
from .transactions import as_of, within_ranges

GAP = 2


#: Members of a range that a reference is resolved to at most; its range node stands for all of them.
MEMBERS = 1000


def parsed(entries: DataFrame) -> DataFrame:
    """sheet, row, col, text and p, the parse."""
    return entries.withColumn("p", parse_formula(F.col("text"), F.col("row"), F.col("col")))


def family_cells(cells: DataFrame) -> DataFrame:
    """What families() needs of parsed cells: sheet, row, col, text, signature, how the ranges move, intent and eligible."""
    ranges = F.filter("p.refs", lambda r: r["down"].isNotNull())
    moves = lambda way: F.array_sort(F.array_distinct(F.transform(ranges, lambda r: r[way])))
    cross = F.exists(ranges, lambda r: (r["sheet"] != "") & (F.upper(r["sheet"]) != F.upper("sheet")))
    return cells.select(
        "sheet", "row", "col", "text", F.col("p.signature").alias("signature"), moves("down").alias("down"), moves("along").alias("along"), cross.alias("cross"),
        intent(F.col("p")).alias("intent"), (F.size("p.unsupported") == 0).alias("eligible"),
    )


def _blocks(cells: DataFrame, line: str, at: str, orientation: str) -> DataFrame:
    """cells with run, family signature and state: member, outlier, or null where the run has no two alike."""
    keyed = runs(cells.withColumn("line", F.col(line)).withColumn("at", F.col(at)), ["sheet", "line"], "at", GAP)
    keys = ["sheet", "line", "run"]
    counts = keyed.groupBy(*keys, "signature").count()
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("count")).alias("n"), F.col("signature").alias("family"))).alias("x")).where("x.n <= -2")
    out = keyed.join(best.select(*keys, "x.family"), keys, "left")
    state = F.when(F.col("family").isNull(), None).when(F.col("signature") == F.col("family"), "member").otherwise("outlier")
    return out.withColumn("state", state).withColumn("orientation", F.lit(orientation))


def families(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(families, assigned cells). Columns first, then rows for cells that no vertical block claimed; the rest are single.

    ``cells``: from family_cells(). Confidence counts the gaps between members and those of the whole run.
    A family has an intent and a window only if all its members agree on one.
    """
    down = _blocks(cells, "col", "row", "vertical")
    left = down.where("state is null").select(*cells.columns)
    along = _blocks(left, "row", "col", "horizontal")
    assigned = down.where("state is not null").unionByName(along).withColumn("state", F.coalesce("state", F.lit("single")))
    keys = ["sheet", "orientation", "line", "run"]
    member, order = F.col("state") == "member", Window.partitionBy(*keys).orderBy("at")
    claimed = assigned.where("state <> 'single'").withColumn("gap", F.col("at") - F.lag("at").over(order) > 1)
    # among a run's members only: the outliers between them have no place of their own
    before = F.last(F.when(member, F.col("at")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    claimed = claimed.withColumn("step", F.when(member, F.col("at") - before))
    moves = F.when(F.col("orientation") == "vertical", F.col("down")).otherwise(F.col("along"))
    of_members = lambda c: F.when(member, c)
    per = claimed.groupBy(*keys).agg(
        F.first("family").alias("signature"), F.count_if(member).alias("members"), F.min(of_members(F.col("at"))).alias("start"), F.max(of_members(F.col("at"))).alias("end"),
        F.count_if(F.col("step") > 1).alias("gaps"), F.count_if("gap").alias("run_gaps"), F.count_if(~member).alias("outliers"), F.min("step").alias("lo"), F.max("step").alias("hi"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(of_members(F.when(F.size(moves) > 0, moves).otherwise(F.array(F.lit("single_cell")))))))).alias("moves"),
        F.coalesce(F.bool_or(of_members(F.col("cross"))), F.lit(False)).alias("cross"), F.collect_set(of_members(F.col("intent"))).alias("intents"), F.bool_and(of_members(F.col("eligible"))).alias("eligible"),
    )
    whole = (F.col("gaps") == 0) & (F.col("run_gaps") == 0)
    confidence = F.when((F.col("members") >= 3) & whole, "HIGH").when(((F.col("members") == 2) & whole) | (F.col("members") >= 3), "MEDIUM").otherwise("LOW")
    regular = F.coalesce(F.col("lo") == F.col("hi"), F.lit(False))
    family_intent = F.when(F.size("intents") == 1, F.element_at("intents", 1)).otherwise("unknown")
    per = per.withColumn("confidence", confidence).withColumn("regular", regular).withColumn("intent", family_intent)
    return per.withColumn("window", window_of(F.col("moves"), F.col("cross"), F.col("members"), F.col("regular"))).drop("lo", "hi", "intents"), assigned


def window_of(moves: Column, cross: Column, members: Column, regular: Column) -> Column:
    """What range a family's references move over: one answer only if all ranges of all members agree, in three members at even steps.

    As frames: fixed is a constant range, expanding unboundedPreceding to here, rolling a sliding frame.
    A range whose start moves towards a fixed end is no window. Single cells beside a range say nothing.
    """
    one = F.element_at(moves, 1)
    known = (members >= 3) & regular & (F.size(moves) == 1) & (one != "contracting")
    outside = F.when(one.isin("fixed", "single_row"), "cross_sheet_fixed").otherwise("cross_sheet_relative")
    return F.when(known, F.when(cross, outside).otherwise(one)).otherwise("UNKNOWN_WINDOW")


def edges(cells: DataFrame, most: int = MEMBERS) -> DataFrame:
    """source, target and kind of every dependency: point, range (a formula cell in a range) and range_node (the range itself).

    Of a range's members the first ``most`` by row and column are listed; the range node stands for all.
    A range in one column is cut where its last listed member is before it meets any cell, so
    running totals down a column cost ``most`` edges a cell. External formulas have no edges.
    """
    own = cells.where(~F.array_contains("p.unsupported", "UNSUPPORTED_EXTERNAL_REFERENCE"))
    name = lambda s, r, c: F.concat_ws("!", s, F.concat(F.lit("R"), r.cast("string"), F.lit("C"), c.cast("string")))
    refs = own.select("sheet", "row", "col", F.explode("p.refs").alias("ref")).withColumn("home", F.col("sheet"))
    refs = refs.withColumn("sheet", F.when(F.col("ref.sheet") == "", F.col("home")).otherwise(F.col("ref.sheet")))
    source = name(F.col("home"), F.col("row"), F.col("col")).alias("source")
    point = refs.where("ref.shape = 'cell'").select(source, name(F.col("sheet"), F.col("ref.r0"), F.col("ref.c0")).alias("target"), F.lit("point").alias("kind"))
    spans = refs.where("ref.shape <> 'cell'")
    nodes = spans.select(source, F.concat_ws("!", F.col("sheet"), F.translate("ref.text", "$", "")).alias("target"), F.lit("range_node").alias("kind"))
    spans = spans.select(F.upper("sheet").alias("sheet"), source, "ref.r0", "ref.r1", "ref.c0", "ref.c1").distinct()
    order = Window.partitionBy("sheet", "c").orderBy("r")
    cells_ = own.select(F.upper("sheet").alias("sheet"), F.col("row").alias("r"), F.col("col").alias("c"), name(F.col("sheet"), F.col("row"), F.col("col")).alias("target")).withColumn("k", F.row_number().over(order))
    # in one column: the first member's number, and with it the row of the last one that is listed
    one = spans.where("c0 = c1").withColumn("c", F.col("c0")).withColumn("at", -F.col("r0"))
    at = cells_.select("sheet", "c", (-F.col("r")).alias("at"), "k")
    first = as_of(one, at, ["sheet", "c"], "at", [F.col("k")], ["k"]).withColumn("last", F.col("k") + most - 1).drop("k", "at_found", "at")
    bound = cells_.select("sheet", "c", F.col("k").alias("last"), F.col("r").alias("bound"))
    one = first.join(bound, ["sheet", "c", "last"], "left").withColumn("r1", F.least("r1", F.coalesce("bound", "r1")))
    columns = ["sheet", "source", "r0", "r1", "c0", "c1"]
    # a whole column covers every bin: its bins are bounded by the rows that the sheet has
    last = cells_.groupBy("sheet").agg(F.max("r").alias("last"))

    def members(spans: DataFrame) -> DataFrame:
        spans = spans.select(*columns).join(last, "sheet").withColumn("r1", F.least("r1", "last")).where("r0 <= r1")
        return within_ranges(cells_, spans, "r", "r0", "r1", ["sheet"], width=1024).where("c between c0 and c1")

    # ranges in one column are cut already: only those over several need their members in order
    wide = Window.partitionBy(*columns).orderBy("r", "c")
    several = members(spans.where("c0 <> c1")).withColumn("n", F.row_number().over(wide)).where(F.col("n") <= most)
    inside = members(one).select("source", "target").unionByName(several.select("source", "target"))
    return point.unionByName(inside.select("source", "target", F.lit("range").alias("kind"))).unionByName(nodes).distinct()


def canonical_cycle(nodes: Column) -> Column:
    """The nodes of a cycle, turned so that the smallest comes first."""
    at = F.array_position(nodes, F.array_min(nodes)).cast("int")
    return F.when(F.size(nodes) > 0, F.concat(F.slice(nodes, at, F.size(nodes)), F.slice(nodes, F.lit(1), at - 1))).otherwise(nodes)


def target_states(targets: DataFrame, cells: DataFrame) -> DataFrame:
    """targets (sheet, row, col) with has_formula and has_value, as the cells stand now; no cell means neither."""
    now = cells.select("sheet", "row", "col", (F.col("kind") == "formula").alias("f"), (F.col("kind") != "blank").alias("v"))
    out = targets.join(now, ["sheet", "row", "col"], "left")
    return out.select("sheet", "row", "col", F.coalesce("f", F.lit(False)).alias("has_formula"), F.coalesce("v", F.lit(False)).alias("has_value"))


def engine_report(found: DataFrame, assigned: DataFrame, edges_: DataFrame | None = None) -> DataFrame:
    """metric, key, n: families by confidence, window and intent, cells by state, edges by kind, edges between sheets."""
    count = lambda df, metric, key: df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).select(F.lit(metric).alias("metric"), "key", "n")
    cross = F.split("source", "!")[0] != F.split("target", "!")[0]
    parts = [count(found, "confidence", "confidence"), count(found, "window", "window"), count(found, "intent", "intent"), count(assigned, "state", "state")]
    if edges_ is not None:
        parts.append(count(edges_, "edges", "kind"))
        parts.append(edges_.agg(F.count_if(cross).alias("n")).select(F.lit("edges").alias("metric"), F.lit("cross_sheet").alias("key"), "n"))
    return reduce(DataFrame.unionByName, parts)
