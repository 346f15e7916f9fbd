"""Statistics of columns and rows of cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.infer import rollup_type
from .cells import as_text, kind_of

CODES = {"string": "t", "integer": "i", "decimal": "n", "date": "d", "datetime": "d", "boolean": "b", "formula": "q"}


#: Kinds that a cell can have.
KINDS = ["blank", "boolean", "date", "datetime", "decimal", "error", "formula", "integer", "number", "string", "time"]


def column_profile(cells: DataFrame) -> DataFrame:
    """Per sheet and column: cells, non-null, distinct values, kinds and the rolled-up type.

    Cells are counted by value first; what a column has of kinds is a bit for each.
    """
    keys = ["sheet", "col", "header"]
    bit = reduce(lambda w, x: w.when(F.col("kind") == x[1], 1 << x[0]), list(enumerate(KINDS))[1:], F.when(F.col("kind") == KINDS[0], 1))
    counted = cells.groupBy(*keys, "text").agg(F.count("*").alias("n"), F.bit_or(bit).alias("bits"))
    full = F.coalesce(F.sum(F.when(F.col("text").isNotNull(), F.col("n"))), F.lit(0))
    per = counted.groupBy(*keys).agg(F.sum("n").alias("n_cells"), full.alias("non_null"), F.count("text").alias("n_distinct"), F.bit_or("bits").alias("bits"))
    first = counted.groupBy(*keys).agg(F.min("text").alias("first_sample"))
    kinds = F.array_compact(F.array(*[F.when(F.col("bits").bitwiseAND(F.lit(1 << i)) != 0, F.lit(k)) for i, k in enumerate(KINDS)]))
    per = per.join(first, keys).withColumn("kinds", kinds)
    return per.select(*keys, "n_cells", "non_null", "n_distinct", rollup_type(F.col("kinds")).alias("type"), F.array_join("kinds", ",").alias("kinds"), "first_sample")


def typed_profile(df: DataFrame, sheet: str, columns: list[str]) -> DataFrame:
    """column_profile() of a table with typed columns: their kinds come from the schema.

    Each column is read on its own and counted by value before anything else, so that
    only distinct values are shuffled. Distinct values are those of the text a cell
    shows (see cells.as_text).
    """
    out = []
    for i, f in enumerate(df.schema[c] for c in columns):
        counted = df.select(as_text(f).alias("text")).groupBy("text").agg(F.count("*").alias("n"))
        n, full = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("text").isNotNull(), F.col("n"))), F.lit(0))
        per = counted.agg(n.alias("n_cells"), full.alias("non_null"), F.count("text").alias("n_distinct"), F.min("text").alias("first_sample"))
        kinds = F.array_sort(F.array_compact(F.array(F.when(F.col("non_null") < F.col("n_cells"), F.lit("blank")), F.when(F.col("non_null") > 0, F.lit(kind_of(f))))))
        head = [F.lit(sheet).alias("sheet"), F.lit(i + 1).alias("col"), F.lit(f.name).alias("header")]
        out.append(per.select(*head, "n_cells", "non_null", "n_distinct", rollup_type(kinds).alias("type"), F.array_join(kinds, ",").alias("kinds"), "first_sample"))
    return reduce(DataFrame.unionByName, out)


def dominant(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value of each group, ties to the smaller one."""
    counts = values.groupBy(*keys, value).count()
    best = F.min(F.struct((-F.col("count")).alias("n"), F.col(value).alias("v"))).alias("x")
    return counts.groupBy(*keys).agg(best, F.sum("count").alias("total")).select(*keys, F.col("x.v").alias(value), (-F.col("x.n")).alias("n"), "total")


def row_profile(cells: DataFrame) -> DataFrame:
    """Per sheet and row: counters by kind, first and last column, and the signature with a letter for each column."""
    code = F.element_at(F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv]), F.col("kind"))
    full = cells.where("kind <> 'blank'").withColumn("code", F.coalesce(code, F.lit(".")))
    count = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    per = full.groupBy("sheet", "row").agg(
        F.count("*").alias("nonempty"),
        count("integer", "decimal").alias("num"),
        count("string").alias("text"),
        count("date", "datetime").alias("datish"),
        count("formula").alias("formula"),
        F.min("col").alias("first_col"),
        F.max("col").alias("last_col"),
        F.map_from_entries(F.collect_list(F.struct("col", "code"))).alias("codes"),
    )
    signature = F.array_join(F.transform(F.sequence(F.lit(1), F.col("last_col")), lambda c: F.coalesce(F.element_at("codes", c), F.lit("."))), "")
    return per.withColumn("sig", signature).drop("codes")


def top_values(values: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """The k most frequent values of each group, with how many there are in all: no cap goes unsaid."""
    counts = values.groupBy(*keys, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), value)
    totals = counts.groupBy(*keys).agg(F.count("*").alias("count_total"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(totals, keys).withColumn("truncated", F.col("count_total") > k)
