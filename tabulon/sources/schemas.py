"""JSON documents against a schema held as rows: what is missing, of the wrong kind or unknown, wherever it is nested.

Documents are variants, walked one level a round: all documents at once, as deep as
the deepest of them. A schema row is (schema, key, required, type, child, many); a key
whose value is an object, or a list of them, names the schema of these as its child.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rounds import stored

SCHEMA = "schema string, key string, required boolean, type string, child string, many boolean"
# What each type of a schema takes, by the names of kinds that errors give.
TAKES = {"str": ["str"], "bool": ["bool"], "number": ["int", "float"], "int": ["int"], "dict": ["dict"], "list": ["list"], "str_or_dict": ["str", "dict"]}
NEAR = 0.5


def schema_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A schema: (schema, key, required, type or None, child or None, many) for each known key."""
    return spark.createDataFrame(rows, SCHEMA)


def kind_of(value: Column) -> Column:
    """str, bool, int, float, dict, list or null of a variant."""
    t = F.schema_of_variant(value)
    known = {"STRING": "str", "BOOLEAN": "bool", "BIGINT": "int", "VOID": "null", "DOUBLE": "float", "FLOAT": "float"}
    named = F.when(F.startswith(t, F.lit("OBJECT")), "dict").when(F.startswith(t, F.lit("ARRAY")), "list").when(F.startswith(t, F.lit("DECIMAL")), "float")
    for name, kind in known.items():
        named = named.when(t == name, kind)
    return named.otherwise("null")


def _nearest(name: pd.Series, known: pd.Series) -> pd.Series:
    close = [difflib.get_close_matches(n, sorted(k), n=1, cutoff=NEAR) for n, k in zip(name, known, strict=True)]
    return pd.Series([c[0] if c else None for c in close], dtype=object)


def problems(docs: DataFrame, schema: DataFrame, root: str, strict: bool = False, store: Callable = stored) -> DataFrame:
    """path, at, code, expected, actual and nearest of everything that speaks against documents.

    ``docs``: path and value (a variant; null: no JSON). Codes: SPEC_INVALID for what is
    missing or of another type than its schema's; unknown keys are SPEC_UNKNOWN_KEY in
    ``strict`` mode, with the nearest known key, else UNKNOWN_SPEC_KEY. What is of the
    wrong type is not walked into. A type that is null takes anything. Schemas are of
    the size of a format; the walk ends with the deepest document. No document, no row.
    """
    here = docs.select("path", F.lit("").alias("at"), F.lit(root).alias("schema"), "value")
    code = "SPEC_UNKNOWN_KEY" if strict else "UNKNOWN_SPEC_KEY"
    # a row for each schema, a list of its keys with it
    keys = F.broadcast(schema.groupBy("schema").agg(F.array_sort(F.collect_set("key")).alias("keys"), F.array_sort(F.collect_set(F.when(F.col("required"), F.col("key")))).alias("needed")))
    rows, found = F.broadcast(schema.select("schema", "key", "type", "child", "many", F.lit(True).alias("known"))), []
    no = F.lit(None).cast("string")
    under = F.concat(F.when(F.col("at") == "", "").otherwise(F.concat("at", F.lit("."))), F.col("key"))
    error = lambda df, at, expected, actual: df.select("path", at.alias("at"), F.lit("SPEC_INVALID").alias("code"), expected.alias("expected"), actual.alias("actual"), no.alias("nearest"))
    while True:
        here = here.withColumn("kind", kind_of(F.col("value")))
        found.append(error(here.where("kind <> 'dict'"), F.when(F.col("at") == "", "<root>").otherwise(F.col("at")), F.lit("dict"), F.col("kind")))
        objects = here.where("kind = 'dict'").withColumn("parts", F.col("value").cast("map<string,variant>")).join(keys, "schema", "left")
        missing = objects.select("path", "at", F.explode(F.array_except("needed", F.map_keys("parts"))).alias("key"))
        found.append(error(missing, under, F.lit("required key present"), F.lit("missing")))
        entries = objects.select("path", "at", "schema", "keys", F.explode("parts").alias("key", "value")).join(rows, ["schema", "key"], "left").withColumn("kind", kind_of(F.col("value")))
        entries = entries.withColumn("at", under)
        near = F.pandas_udf(_nearest, "string")(F.col("key"), F.coalesce("keys", F.array().cast("array<string>"))) if strict else no
        unknown = entries.where("known is null").select("path", "at", "key", "keys", "kind")
        found.append(unknown.select("path", "at", F.lit(code).alias("code"), F.lit("known key").alias("expected"), F.concat(F.lit("unknown key ("), "kind", F.lit(")")).alias("actual"), near.alias("nearest")))
        fits = F.col("type").isNull()
        for name, kinds in TAKES.items():
            fits = fits | ((F.col("type") == name) & F.col("kind").isin(kinds))
        entries = entries.where("known").withColumn("fits", fits)
        found.append(error(entries.where("not fits"), F.col("at"), F.col("type"), F.col("kind")))
        inner = entries.where("fits and child is not null")
        lists = inner.where("kind = 'list'").select("path", "at", "child", F.posexplode(F.col("value").cast("array<variant>")).alias("n", "value"))
        lists = lists.select("path", F.concat("at", F.lit("["), F.col("n").cast("string"), F.lit("]")).alias("at"), F.col("child").alias("schema"), "value")
        single = inner.where("kind = 'dict' and not coalesce(many, false)").select("path", "at", F.col("child").alias("schema"), "value")
        # variants are stored as their text
        here = store(lists.unionByName(single).withColumn("value", F.to_json("value"))).withColumn("value", F.parse_json("value"))
        if not here.limit(1).count():
            return reduce(DataFrame.unionByName, found)


def source_tables(docs: DataFrame) -> DataFrame:
    """path, table, row, column, value: the cells of the tables (headers and rows) of JSON sources under "tables".

    Values are texts as JSON has them without quotes, null for null and for cells that
    a short row lacks; cells beyond the headers go. A header that comes twice keeps
    its place. Tables without headers or rows give none.
    """
    tables = docs.select("path", F.explode(F.try_variant_get("value", "$.tables", "map<string,variant>")).alias("table", "t"))
    parts = tables.select("path", "table", F.try_variant_get("t", "$.headers", "array<string>").alias("headers"), F.posexplode(F.try_variant_get("t", "$.rows", "array<variant>")).alias("row", "cells"))
    cells = parts.select("path", "table", "row", F.col("cells").try_cast("array<string>").alias("own"), F.posexplode("headers").alias("place", "column"))
    return cells.select("path", "table", "row", "place", "column", F.get("own", F.col("place")).alias("value"))
