"""Scalar kinds: of source text, of delimited text, and of a whole column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ["blank", "boolean", "integer", "decimal", "date", "datetime", "string", "formula", "mixed"]

SOURCE_DATE = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2})?)?|[0-9]{1,2}[./-][0-9]{1,2}[./-]([0-9]{4}|[0-9]{2}))$"


def infer_source(text: Column) -> Column:
    """struct(kind, value) of a source text: blank, boolean, integer, decimal, date or string.

    All spaces are dropped before numbers are read; of comma and point the later
    one is the decimal mark, and a lone comma is one. Dates stay text.
    """
    t = F.trim(text)
    low = F.lower(t)
    bare = F.regexp_replace(t, r"\s", "")
    comma_last = F.instr(F.reverse(bare), ",") < F.instr(F.reverse(bare), ".")
    number = (
        F.when(bare.contains(",") & bare.contains("."), F.when(comma_last, F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(bare, F.lit(","), F.lit(""))))
        .when(bare.contains(","), F.replace(bare, F.lit(","), F.lit(".")))
        .otherwise(bare)
    )
    kind = (
        F.when(text.isNull() | (t == ""), "blank")
        .when(low.isin("true", "false", "evet", "hayir", "hayır", "yes", "no"), "boolean")
        .when(bare.rlike("^[+-]?[0-9]+$"), "integer")
        .when(number.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), "decimal")
        .when(t.rlike(SOURCE_DATE), "date")
        .otherwise("string")
    )
    value = (
        F.when(kind == "blank", F.lit(None).cast("string"))
        .when(kind == "boolean", F.when(low.isin("true", "evet", "yes"), "true").otherwise("false"))
        .when(kind == "integer", F.regexp_replace(bare, r"^\+", ""))
        .when(kind == "decimal", F.regexp_replace(number, r"^\+", ""))
        .otherwise(t)
    )
    return F.struct(kind.alias("kind"), value.alias("value"))


def infer_csv(text: Column) -> Column:
    """Kind of a delimited field: blank, formula, boolean, integer, decimal, date, datetime or string."""
    t = F.trim(text)
    return (
        F.when(text.isNull() | (text == ""), "blank")
        .when(text.startswith("="), "formula")
        .when(F.lower(text).isin("true", "false"), "boolean")
        .when(t.rlike("^[+-]?[0-9]+(_[0-9]+)*$"), "integer")
        .when(t.rlike(r"^[+-]?([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?$") | F.lower(t).rlike("^[+-]?(nan|inf|infinity)$"), "decimal")
        .when(text.rlike("^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$"), "date")
        .when(text.rlike("^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])[T ]([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?$"), "datetime")
        .otherwise("string")
    )


def rollup_type(kinds: Column) -> Column:
    """One kind for a column from the set of its cells' kinds; blanks and formulas count only when alone."""
    real = F.array_except(kinds, F.array(F.lit("blank"), F.lit("formula")))
    within = lambda *names: F.size(F.array_except(real, F.array(*map(F.lit, names)))) == 0
    return (
        F.when(F.size(real) == 0, F.when(F.array_contains(kinds, "formula"), "formula").otherwise("blank"))
        .when((F.size(real) == 2) & within("integer", "decimal"), "decimal")
        .when(within("date", "datetime"), "datetime")
        .when(F.size(real) == 1, F.element_at(real, 1))
        .otherwise("mixed")
    )


def compatible(source: Column, target: Column) -> Column:
    """How a source kind fits a target kind."""
    numbers, dates = ["integer", "decimal"], ["date", "datetime"]
    return (
        F.when(source == target, "exact")
        .when(source.isin(numbers) & target.isin(numbers), "numeric_family")
        .when(source.isin(dates) & target.isin(dates), "date_family")
        .when((source == "blank") | (target == "blank"), "blank_tolerant")
        .otherwise("mismatch")
    )
