"""Mixing sources to target weights, measured in words.

Every document gets a hash-random key; documents are range-sorted by (source,
key), a running sum inside each range and a prefix sum over the ranges give each
document its place in its source, and each source is cut where its budget ends:
whole epochs first, then the part of one more epoch. The cut falls inside one
document, so that the budget is met exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, drop, id_text, parts, store

#: No source gives more than so many times its own size.
MOST = 3


def source_budgets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, share: float = 1.0) -> DataFrame:
    """source, source_size, target: what each source gives of ``share`` of all words.

    Sources stand in code-point order, null last, and take the ``weights`` in
    turn. A target over ``most`` times its source's size stops there; what is
    left goes to the others by weight, until none is above. In closed form: with
    sources sorted by size per weight, the first k stop, for the smallest k at
    which the next one is within its bound. Sources without words get 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    per = per.withColumn("w", F.element_at(cycle, (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    by = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before, every = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = (
        per.withColumn("all", F.sum("source_size").over(every) * share)
        .withColumn("weight", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("stopped", F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0)).cast("double"))
        .withColumn("level", (F.col("all") - F.col("stopped")) / F.col("weight"))
        .withColumn("stops", F.col("level") * F.col("w") > F.col("source_size") * most)
    )
    # the sources that stop come first in this order; the level of the first that does not is everyone's
    level = F.min(F.when(~F.col("stops"), F.struct(F.col("source_size") / F.col("w"), "level"))).over(every)["level"]
    return per.select("source", "source_size", F.when(F.col("stops"), (F.col("source_size") * most).cast("double")).otherwise(level * F.col("w")).alias("target"))


def _ranges(batches):
    """Running sums of size by source inside one sorted range; batches of one task follow each other."""
    from pyspark import TaskContext

    task, source, total = TaskContext.get().partitionId(), None, 0
    for pdf in batches:
        if not len(pdf):
            continue
        name = pdf["source"].to_numpy(dtype=object)
        mark = pd.Series(name).isna().to_numpy()
        new = np.ones(len(pdf), bool)
        new[1:] = (name[1:] != name[:-1]) & ~(mark[1:] & mark[:-1])
        if source is not None and source == (mark[0], None if mark[0] else name[0]):
            new[0] = False
        size = pdf["size"].to_numpy()
        sums = np.cumsum(size) - size
        first = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        start = np.where(run >= 0, sums[first[np.maximum(run, 0)]] if len(first) else 0, -total)
        pdf["range"], pdf["inside"] = task, sums - start
        total = int(pdf["inside"].iloc[-1] + size[-1])
        source = (mark[-1], None if mark[-1] else name[-1])
        yield pdf


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, seed: str = "mix", size: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, partial, taken for every row of ``docs``.

    ``epochs``: times the whole document is taken; ``partial``: words of it that
    one more epoch takes (its first ones; only one document of a source gives
    less than all of it there); taken = epochs * size + partial. Size counts the
    words of text, null 0, unless given. A null source is a source. Reruns agree:
    the key is a hash of the id, ties go by id and size. Equal rows share a key,
    and which of them comes first makes no difference. Empty tables give none.
    """
    measured = docs.select("doc_id", "source", (size if size is not None else F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))).cast("long").alias("size"))
    sizes = store(measured.withColumn("key", F.md5(F.concat(F.lit(seed), id_text()))), "sizes")
    budgets = store(source_budgets(sizes, weights, most), "budgets")
    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id"), F.col("size")]
    ranged = sizes.repartitionByRange(parts(docs.sparkSession), *order).sortWithinPartitions(*order)
    schema = T.StructType([*sizes.schema.fields, T.StructField("range", T.IntegerType()), T.StructField("inside", T.LongType())])
    placed = store(ranged.mapInPandas(_ranges, schema), "placed")
    drop(sizes)
    # a source lies in neighbouring ranges: few sums for each, however many documents it has
    sums = placed.groupBy("source", "range").agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    joined = placed.join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).drop("s", "r")
    # one row for each source, as many as there are sources: Spark broadcasts them where they are small
    b = budgets.select(F.col("source").alias("s"), "source_size", "target")
    joined = joined.join(b, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - F.col("epochs") * F.col("source_size")
    partial = F.least(F.greatest(rest - F.col("base") - F.col("inside"), F.lit(0)), F.col("size")).cast("long")
    out = joined.withColumn("epochs", epochs).withColumn("partial", partial)
    return out.select("doc_id", "source", "size", "source_size", "target", "epochs", "partial", (F.col("epochs") * F.col("size") + F.col("partial")).alias("taken"))


#: Between a word and the white space after it.
WORD_END = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"


def take(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, seed: str = "mix") -> DataFrame:
    """The mix itself: rows of ``docs`` repeated as ``mix`` says, the document at a source's cut ending after its last word taken.

    Keeps the columns of ``docs``; n_chars, where there is one, follows the text.
    Rows that the mix does not take are left out, and so are texts without
    words. Rows that are equal in doc_id and text all follow the plan of one.
    """
    text_hash = F.xxhash64("text")
    mixed = mix(docs.select(F.struct("doc_id", text_hash.alias("h")).alias("doc_id"), "source", "text"), weights, most, seed)
    plan = mixed.where("taken > 0").select(F.col("doc_id.doc_id").alias("id"), F.col("doc_id.h").alias("h"), F.col("epochs").cast("int").alias("epochs"), "partial", "size")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    rows = rows.join(plan.dropDuplicates(["id", "h"]), F.col("doc_id").eqNullSafe(F.col("id")) & (text_hash == F.col("h")))
    whole = F.array_repeat(F.col("size"), F.col("epochs"))
    rows = rows.withColumn("words", F.explode(F.when(F.col("partial") > 0, F.concat(whole, F.array("partial"))).otherwise(whole)))
    cut = F.array_join(F.slice(F.split("text", WORD_END), 1, F.col("words").cast("int")), "")
    rows = rows.withColumn("text", F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(cut))
    return with_text(rows, docs, F.col("words") < F.col("size"))


def with_text(rows: DataFrame, docs: DataFrame, changed: Column) -> DataFrame:
    """The columns of ``docs`` out of ``row``, with the new text, and n_chars with it where it has changed."""
    out = []
    for f in docs.schema:
        old = F.col("row").getField(f.name)
        new = F.col("text") if f.name == "text" else F.when(changed, F.length("text").cast(f.dataType)).otherwise(old) if f.name == "n_chars" else old
        out.append(new.alias(f.name))
    return rows.select(*out)
