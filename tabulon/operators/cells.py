"""Tables as cells: one row for each (sheet, row, col) with kind and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kind_of(field: T.StructField) -> str:
    """Kind of a typed column's values."""
    if isinstance(field.dataType, T.BooleanType):
        return "boolean"
    if isinstance(field.dataType, T.IntegralType):
        return "integer"
    if isinstance(field.dataType, (T.FractionalType, T.DecimalType)):
        return "decimal"
    if isinstance(field.dataType, T.DateType):
        return "date"
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "string"


def as_text(field: T.StructField) -> Column:
    """A value as text: numbers with fractions to four places, times to the second."""
    kind = kind_of(field)
    if kind == "decimal":
        return F.format_string("%.4f", F.col(field.name).cast("double"))
    if kind == "datetime":
        return F.date_format(field.name, "yyyy-MM-dd HH:mm:ss")
    return F.col(field.name).cast("string")


def cells(df: DataFrame, sheet: str, row: Column, columns: list[str] | None = None) -> DataFrame:
    """sheet, row, col (from 1), header, kind, text for every value of ``columns``; a null is a blank cell.

    One narrow pass: each row becomes an array of cells that is exploded, with no shuffle.
    """
    fields = [df.schema[c] for c in columns or df.columns]
    made = [
        F.struct(
            F.lit(i + 1).alias("col"), F.lit(f.name).alias("header"), F.when(F.col(f.name).isNull(), "blank").otherwise(kind_of(f)).alias("kind"),
            F.when(F.col(f.name).isNotNull(), as_text(f)).alias("text"),
        )
        for i, f in enumerate(fields)
    ]
    return df.select(F.lit(sheet).alias("sheet"), row.cast("long").alias("row"), F.inline(F.array(*made)))
