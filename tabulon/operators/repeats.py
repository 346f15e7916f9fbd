"""Repeated structures of sheets: headers that come again, blocks of rows with equal signatures, and periodic stretches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .assembly import is_sparse
from .restructure import range_text
from .sequence import runs

# Scores of what repeats, the periods looked for, and the least share of equal labels of two headers.
SPARSE, TWICE, OFTEN, HEADER = 45, 65, 80, 80
PERIODS = (2, 3, 4, 5, 6)
ALIKE = 0.6


def _level(score: Column) -> Column:
    return F.when(score >= OFTEN, "HIGH").when(score >= TWICE, "MEDIUM").otherwise("LOW")


def _body(rows: DataFrame) -> DataFrame:
    """Rows of bands of three rows or more: ``band`` (its first row), ``place`` in it, signatures filled up to the band's width, ``block`` of equal ones."""
    order = Window.partitionBy("sheet", "run").orderBy("row")
    # one order serves the whole band and what comes before in it: each order more would hold all rows of a task once more
    band = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sig = F.coalesce("sig", F.lit(""))
    full = runs(rows.where("nonempty > 0").select("sheet", "row", "first_col", "last_col", sig.alias("sig")), ["sheet"], "row")
    wide = full.withColumns({"band": F.min("row").over(band), "last": F.max("row").over(band), "width": F.coalesce(F.max("last_col").over(band), F.lit(0))})
    wide = wide.where("last - band >= 2").withColumn("sig", F.rpad("sig", F.greatest(F.length("sig"), F.col("width")), F.lit(".")))
    new = F.coalesce((F.col("sig") != F.lag("sig").over(order)).cast("int"), F.lit(0))
    return wide.withColumns({"new": new, "place": F.col("row") - F.col("band")}).withColumn("block", F.sum("new").over(order)).drop("run", "last", "width", "new")


def repeated_blocks(rows: DataFrame) -> DataFrame:
    """One row for each run of neighbouring rows with one signature that its band holds in two runs or more.

    ``rows``: sheet, row, nonempty, first_col, last_col, sig. Gives sheet, band, signature, first_row, last_row, ref,
    occurrences, rows_per_run (of the first run), score and level: LOW where most of the signature is empty, HIGH from
    three runs on. Bands of one or two rows hold none; a null signature is an empty one. Rows are to be unique in a sheet.
    """
    per = _body(rows).groupBy("sheet", "band", "block", "sig").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.min("first_col").alias("a"), F.max("last_col").alias("b"))
    same = Window.partitionBy("sheet", "band", "sig").orderBy("first_row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    size = F.first(F.col("last_row") - F.col("first_row") + 1).over(same)
    per = per.withColumns({"occurrences": F.count("*").over(same), "rows_per_run": size}).where("occurrences >= 2")
    score = F.when(is_sparse(F.col("sig")), SPARSE).when(F.col("occurrences") >= 3, OFTEN).otherwise(TWICE)
    ref = range_text(F.col("a"), F.col("first_row"), F.col("b"), F.col("last_row"))
    return per.select("sheet", "band", F.col("sig").alias("signature"), "first_row", "last_row", ref.alias("ref"), "occurrences", "rows_per_run", score.alias("score"), _level(score).alias("level"))


def _islands(body: DataFrame) -> DataFrame:
    """sheet, band, period, f, l: maximal places f to l that equal the place a period before, a period long or more.

    All periods are found in one ordered pass: of each island only its last row is passed on.
    """
    order = Window.partitionBy("sheet", "band").orderBy("place")
    marked = body.withColumns({f"same{p}": F.coalesce(F.col("sig") == F.lag("sig", p).over(order), F.lit(False)) for p in PERIODS})
    ends = {}
    for p in PERIODS:
        before = F.coalesce(F.max(F.when(~F.col(f"same{p}"), F.col("place"))).over(order), F.lit(-1))
        final = F.col(f"same{p}") & ~F.coalesce(F.lead(f"same{p}").over(order), F.lit(False)) & (F.col("place") - before >= p)
        ends[f"end{p}"] = F.when(final, F.struct(F.lit(p).alias("period"), (before + 1).alias("f"), F.col("place").alias("l")))
    found = marked.withColumns(ends).select("sheet", "band", F.array_compact(F.array(*ends)).alias("e"))
    return found.where("size(e) > 0").select("sheet", "band", F.inline("e"))


def _stretches(islands: DataFrame) -> DataFrame:
    """sheet, band, period, start, end: the longest of the stretches that a scan from the first row on would take, one after another.

    A stretch begins a period before its island, or behind the stretch taken before it, and is taken if it holds two
    periods. Only the island just before can be in the way, as each is a period long itself. An island that is long enough
    whatever was taken before is sure; the others are taken in turn, every second one after a sure one.
    """
    order = Window.partitionBy("sheet", "band", "period").orderBy("f")
    cut = F.greatest(F.lit(0), F.coalesce(F.lag("l").over(order) + 1 - (F.col("f") - F.col("period")), F.lit(0)))
    own = islands.withColumn("cut", cut).withColumn("sure", (F.col("l") - F.col("f") + 1 >= F.col("period") + F.col("cut")).cast("int"))
    own = own.withColumn("chain", F.sum("sure").over(order))
    turn = F.row_number().over(Window.partitionBy("sheet", "band", "period", "chain").orderBy("f"))
    own = own.withColumn("taken", turn % 2 == 1).withColumn("behind", F.coalesce(F.lag("taken").over(order), F.lit(False)))
    start = F.col("f") - F.col("period") + F.when(F.col("behind"), F.col("cut")).otherwise(0)
    taken = own.where("taken").withColumn("start", start)
    best = F.max_by(F.struct("start", F.col("l").alias("end")), F.struct(F.col("l") - F.col("start"), -F.col("start")))
    return taken.groupBy("sheet", "band", "period").agg(best.alias("s")).select("sheet", "band", "period", "s.start", "s.end")


def periods(rows: DataFrame, cover: float | None = None) -> DataFrame:
    """The longest stretch of each band in which signatures come again every 2, 3, 4, 5 or 6 rows, twice or more often.

    Smaller periods come first: a stretch whose rows all lie in those reported before isn't reported, nor is one of a
    single signature. ``covered`` says how many of its rows lie in repeated blocks; with ``cover``, stretches of which at
    least that share does are left out. A row of such a stretch has its like a period away, in another run, so that
    ``covered`` is the whole stretch: with a ``cover`` of 1 or less (the reference's 0.8) nothing is left, by definition.

    ``rows`` as in ``repeated_blocks``. Gives sheet, band, period, first_row, last_row, unit (its signatures),
    occurrences, covered, score and level.
    """
    body = _body(rows)
    order = Window.partitionBy("sheet", "band").orderBy("place")
    same = Window.partitionBy("sheet", "band", "sig")
    again = F.min("block").over(same) < F.max("block").over(same)
    body = body.withColumn("again", again.cast("int")).withColumn("known", F.sum("again").over(order))
    # a period's signatures and the last row of each stretch: seven places of a band and period at most
    places = F.array_union(F.sequence(F.col("start"), F.col("start") + F.col("period") - 1), F.array("end"))
    wanted = _stretches(_islands(body)).withColumn("place", F.explode(places))
    met = wanted.join(body, ["sheet", "band", "place"])
    unit = F.array_sort(F.collect_list(F.when(F.col("place") < F.col("start") + F.col("period"), F.struct("place", "sig"))))
    each = met.groupBy("sheet", "band", "period", "start", "end").agg(
        F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.array_join(F.transform(unit, lambda x: x["sig"]), " / ").alias("unit"),
        (F.min("block") == F.max("block")).alias("flat"), (F.max("known") - F.min("known") + F.min_by("again", "place")).alias("covered"),
    )
    each = each.where("not flat")
    if cover is not None:
        each = each.where(F.col("covered") < cover * (F.col("end") - F.col("start") + 1))
    fields = ["period", "start", "end", "first_row", "last_row", "unit", "covered"]
    found = each.groupBy("sheet", "band").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("c"))

    def inside(x: Column, kept: Column) -> Column:
        """Whether x lies in what the kept ones cover together: the first place of it that none of them reaches is behind its end."""
        by_start = F.array_sort(F.transform(kept, lambda y: F.struct(y["start"].alias("s"), y["end"].alias("e"))))
        return F.aggregate(by_start, x["start"], lambda at, y: F.when((y["s"] <= at) & (y["e"] >= at), y["e"] + 1).otherwise(at)) > x["end"]

    # five at most, one for each period
    kept = F.aggregate("c", F.filter("c", lambda x: F.lit(False)), lambda acc, x: F.when(inside(x, acc), acc).otherwise(F.concat(acc, F.array(x))))
    out = found.select("sheet", "band", F.inline(kept)).withColumn("occurrences", F.floor((F.col("end") - F.col("start") + 1) / F.col("period")).cast("int"))
    score = F.when(F.col("occurrences") >= 3, OFTEN).otherwise(TWICE)
    return out.select("sheet", "band", "period", "first_row", "last_row", "unit", "occurrences", "covered", score.alias("score"), _level(score).alias("level"))


def repeated_headers(labels: DataFrame) -> DataFrame:
    """sheet, row, repeats, occurrence, score, level: headers that repeat an earlier one of their sheet, and which.

    ``labels``: sheet, row (first row of a header), col, label (normalised; null: none). Two headers are alike where at
    least three fifths of the columns that both name have equal labels; of several earlier ones the first counts.
    Equal headers are one class, and only classes that share a label in a column are compared.
    """
    named = labels.where("label is not null")
    whole = named.groupBy("sheet", "row").agg(F.array_sort(F.collect_list(F.struct("col", "label"))).alias("sig"))
    classes = whole.groupBy("sheet", "sig").agg(F.min("row").alias("first"))
    cell = classes.select("sheet", "first", F.transform("sig", lambda x: x["col"]).alias("cols"), F.inline("sig"))
    other = cell.select("sheet", F.col("first").alias("earlier"), F.col("cols").alias("its"), "col", "label")
    equal = cell.join(other, ["sheet", "col", "label"]).groupBy("sheet", "first", "earlier").agg(F.count("*").alias("n"), F.first("cols").alias("cols"), F.first("its").alias("its"))
    alike = equal.where(F.col("n") >= ALIKE * F.size(F.array_intersect("cols", "its"))).groupBy("sheet", "first").agg(F.min("earlier").alias("repeats"))
    found = whole.join(classes, ["sheet", "sig"]).join(alike, ["sheet", "first"]).where("repeats < row")
    nth = F.row_number().over(Window.partitionBy("sheet", "repeats").orderBy("row")) + 1
    return found.select("sheet", "row", "repeats", nth.alias("occurrence"), F.lit(HEADER).alias("score"), F.lit("HIGH").alias("level"))


def pattern_blocks(blocks: DataFrame) -> DataFrame:
    """What ``repeated_blocks`` found as blocks of a sheet: block_id, archetype, row_archetype, occurrences, rows_per_run, score, level, evidence."""
    per = blocks.groupBy("sheet", "band", "signature").agg(*[F.first(c).alias(c) for c in ("occurrences", "rows_per_run", "score", "level")])
    evidence = F.concat_ws(";", F.lit("repeated_type:repeated_row_block"), F.concat(F.lit("occurrences:"), F.col("occurrences").cast("string")), F.concat(F.lit("signature:"), F.col("signature")))
    return per.select("sheet", "band", F.concat(F.lit("p"), F.col("signature")).alias("block_id"), F.lit("repeated_pattern").alias("archetype"), F.lit("record_row").alias("row_archetype"), "occurrences", "rows_per_run", "score", "level", evidence.alias("evidence"))
