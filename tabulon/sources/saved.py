"""Saved JSON documents, many at once: document maps, profiles, policies and plans, with what is wrong with each.

A document is one row with its parsed value; nothing is trusted that its problems()
speak against.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a policy says unless it says otherwise, what it may say, and marks of a plan that writes formulas.
POLICY = {"allow_expansion": False, "allow_lookup": False, "allow_unverified_region_overwrite": False, "max_rows": None, "missing_required": "report_only", "on_conflict": "block", "on_low_confidence": "report_only"}
ALLOWED = {"on_conflict": ["report", "block"], "on_low_confidence": ["report_only", "block"]}
SYNTHESIS = {"$.executor_contract.plan_type": "formula_synthesis", "$.write_policy": "write_formula"}


def read_saved(spark: SparkSession, path: str) -> DataFrame:
    """path and value (a variant, null for what is no JSON) of every file; large files are read whole, each by one task."""
    files = spark.read.option("wholetext", True).text(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("value"))


def field(path: str, kind: str = "string", value: str = "value") -> Column:
    """One field of a document; null where it is missing or of another kind."""
    return F.try_variant_get(F.col(value), path, kind)


def _kind(path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(F.col("value"), path, "variant"))


def problems(docs: DataFrame, what: str) -> DataFrame:
    """path and code of everything that speaks against documents of one sort: map, profile, policy, fill_plan or synthesis_plan."""
    is_list = lambda p: F.startswith(F.coalesce(_kind(p), F.lit("")), F.lit("ARRAY"))
    is_object = F.startswith(F.coalesce(F.schema_of_variant("value"), F.lit("")), F.lit("OBJECT"))
    checks = {"NOT_JSON": F.col("value").isNull(), "NOT_AN_OBJECT": F.col("value").isNotNull() & ~is_object}
    if what in ("map", "profile"):
        checks["SHEETS_MISSING"] = is_object & ~is_list("$.sheets")
    elif what == "fill_plan":
        checks["PLAN_ID_INVALID"] = is_object & ~F.coalesce(field("$.plan_id").rlike("^[0-9a-f]{32,64}$"), F.lit(False))
        for name in ("would_write", "blocked", "preserved"):
            checks[f"{name.upper()}_MISSING"] = is_object & ~is_list(f"$.{name}")
    elif what == "synthesis_plan":
        for path, value in SYNTHESIS.items():
            checks[f"{path.rpartition('.')[2].upper()}_INVALID"] = is_object & ~F.coalesce(field(path) == value, F.lit(False))
        n = F.size(F.coalesce(field("$.actions", "array<variant>"), F.array().cast("array<variant>")))
        checks["ACTION_COUNT_WRONG"] = is_object & ~F.coalesce(field("$.generated_formula_count", "int") == n, F.lit(False))
    elif what == "policy":
        keys = F.map_keys(F.coalesce(F.col("value").try_cast("map<string,variant>"), F.create_map().cast("map<string,variant>")))
        checks["UNKNOWN_KEY"] = F.size(F.array_except(keys, F.array(*map(F.lit, POLICY)))) > 0
        for key, values in ALLOWED.items():
            checks[f"{key.upper()}_INVALID"] = F.array_contains(keys, key) & ~F.coalesce(field(f"$.{key}").isin(values), F.lit(False))
        rows = F.coalesce(_kind("$.max_rows"), F.lit("VOID"))
        checks["MAX_ROWS_INVALID"] = F.array_contains(keys, "max_rows") & ~rows.isin("BIGINT", "VOID")
    else:
        raise ValueError(f"unknown sort of document: {what}")
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))
    return docs.select("path", F.explode(found).alias("code"))


def policies(docs: DataFrame) -> DataFrame:
    """path and each policy key as text: what the document says, else the default."""
    default = lambda k: F.lit(None if POLICY[k] is None else json.dumps(POLICY[k]).strip('"')).cast("string")
    return docs.select("path", *[F.coalesce(field(f"$.{k}"), default(k)).alias(k) for k in POLICY])


def sheets(docs: DataFrame) -> DataFrame:
    """path, name and sheet (a variant) of every sheet of maps or profiles, in order."""
    rows = docs.select("path", F.posexplode(field("$.sheets", "array<variant>")).alias("place", "sheet"))
    return rows.select("path", "place", F.try_variant_get("sheet", "$.name", "string").alias("name"), "sheet")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 and bytes of every file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
