"""Preflight of a fill plan for each order: its line items are the planned writes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.preflight import preflight
from ..sources.schemas import problems, schema_rows
from .registry import DEALT, query, table

_PLAN = "CAST(100000000000 + o_orderkey AS VARCHAR)"


@query(f"""WITH o AS (SELECT *, {_PLAN} AS plan, o_orderkey AS k FROM orders),
l AS (SELECT o.plan, k, row_number() OVER (PARTITION BY k ORDER BY l_linenumber, l_quantity, l_returnflag, l_linestatus) AS n, CAST(l_quantity AS INT) AS q, l_returnflag AS flag, l_linestatus AS status FROM lineitem JOIN o ON o_orderkey = l_orderkey),
w AS (SELECT plan, CASE WHEN n = 6 THEN 'X' ELSE 'S' END || '!A' || (n + 1) AS subject, CASE WHEN flag = 'A' AND n = 1 THEN 'PLAN_INVALID' WHEN n = 6 THEN 'EXECUTION_BLOCKED' WHEN k % 3 = 0 AND n = 3 THEN 'MERGED_CELL_WRITE_FORBIDDEN'
  WHEN status = 'O' AND n % 4 = 0 THEN 'FORMULA_MODIFICATION_FORBIDDEN' WHEN n = 5 AND k % 2 = 0 THEN 'SOURCE_CHANGED' WHEN k % 17 = 0 THEN 'SOURCE_CHANGED' WHEN q > 40 THEN 'VALIDATION_MISMATCH' END AS code FROM l)
SELECT plan, code, subject FROM w WHERE code IS NOT NULL
UNION ALL SELECT plan, 'PLAN_INVALID', 'profile' FROM o WHERE o_orderstatus = 'P'
UNION ALL SELECT plan, 'STALE_PLAN', 'structure' FROM o WHERE k % 11 = 0
UNION ALL SELECT plan, 'PLAN_TRUNCATED', 'would_write' FROM o WHERE k % 13 = 0
UNION ALL SELECT plan, CASE WHEN k % 2 = 0 THEN 'APPROVAL_REQUIRED' ELSE 'APPROVAL_INVALID' END, 'token' FROM o WHERE k % 5 = 0
UNION ALL SELECT plan, 'EXECUTION_BLOCKED', 'blocked cells' FROM o WHERE k % 19 = 0
UNION ALL SELECT plan, 'EXECUTION_BLOCKED', 'conflicts' FROM o WHERE k % 23 = 0 AND k % 2 = 0""")
def preflight_blockers(spark, sf_dir):
    """Everything that stands against each plan."""
    # plans are numbers until the end: these are put in order faster than their texts
    first = F.lit(100000000000)
    key, no = F.col("plan") - first, lambda t: F.lit(None).cast(t)
    o = table(spark, sf_dir, "orders").select((first + F.col("o_orderkey")).alias("plan"), "o_orderstatus")
    token = F.when(key % 5 != 0, F.left(F.col("plan").cast("string"), F.lit(12))).when(key % 2 != 0, "other")
    given = {"plan_profile": F.lit("p"), "profile": F.when(F.col("o_orderstatus") == "P", "q").otherwise("p"), "plan_structure": F.lit("s"), "live_structure": F.when(key % 11 == 0, "t").otherwise("s"), "truncated": key % 13 == 0, "requires_approval": F.lit(True), "token": token, "on_conflict": F.when(key % 2 == 0, "block").otherwise("report")}
    flags = {c: no("boolean") for c in ("expanded", "same_output", "in_place", "evidence", "expansion_needed", "authorized", "applied", "apply_required", "flag_needed")}
    look = no("struct<table_kind: string, key_from: string, key_column: string, result_column: string, target_column: string, in_block: boolean>")
    plans = o.select("plan", *[c.alias(n) for n, c in (given | flags).items()], no("string").alias("missing_required"), look.alias("lookup"))
    lists = {"blocked": o.where(key % 19 == 0).select("plan", F.lit("merged").alias("reason")), "conflicts": o.where(key % 23 == 0).select("plan"), "unresolved": o.where(key % 29 == 0).select("plan")}
    n, row = F.col("n"), (F.col("n") + 1).cast("int")
    # both tables are dealt by plan once, and all that is told of writes is made of the two
    at = ["l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"]
    items = table(spark, sf_dir, "lineitem")
    tasks = -(-items.count() // DEALT)
    # fewer than Spark's number would be dealt anew by the joins
    dealt = [tasks, "plan"] if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else ["plan"]
    own = o.select("plan").repartition(*dealt)
    lines = items.select((first + F.col("l_orderkey")).alias("plan"), *at).repartition(*dealt).join(own, "plan").withColumn("text", F.col("l_quantity").cast("int").cast("string"))
    # line numbers repeat in an order: its lines are counted
    lines = lines.withColumn("n", F.row_number().over(Window.partitionBy("plan").orderBy(*at)))
    writes = lines.select("plan", n.alias("seq"), F.when(n == 6, "X").otherwise("S").alias("sheet"), F.concat(F.lit("A"), row.cast("string")).alias("cell"), F.concat(F.lit("K["), (n - 1).cast("string"), F.lit("]")).alias("source"), F.when((F.col("l_returnflag") == "A") & (n == 1), "keep").otherwise("write_value").alias("write_policy"), F.when(key % 17 == 0, "old").otherwise(F.col("text")).alias("preview"), F.lit(True).alias("format_compatible"), F.lit(True).alias("role_compatible"))
    each = own.select("plan", F.lit("S").alias("sheet"))
    live = {
        "sheets": each,
        "cells": lines.where((F.col("l_linestatus") == "O") & (n % 4 == 0)).select("plan", F.lit("S").alias("sheet"), row.alias("row"), F.lit(1).alias("col"), F.lit("=1").alias("text")),
        "merges": own.where(key % 3 == 0).select("plan", F.lit("S").alias("sheet"), F.lit("A3:A4").alias("ref")),
        "validations": each.select("*", F.lit("A2:A99").alias("ref"), F.lit(1).alias("n"), F.lit("whole").alias("type"), no("string").alias("operator"), F.lit("1").alias("formula1"), F.lit("40").alias("formula2")),
        "columns": each.select("*", F.lit(1).alias("col"), F.lit("integer").alias("value_kind"), F.lit(True).alias("required")),
    }
    source = lines.where(~((n == 5) & (key % 2 == 0))).select("plan", F.lit("K").alias("source_key"), (n - 1).cast("long").alias("offset"), F.col("text").alias("value"))
    return preflight(plans, lists, writes, live, source, dealt=dealt).withColumn("plan", F.col("plan").cast("string"))


#: A specification with cells: (schema, key, required, type, child, many).
SPEC = [("spec", "name", True, "str", None, False), ("spec", "size", False, "int", None, False), ("spec", "cells", True, "list", "cell", True), ("cell", "at", True, "str", None, False)]


@query("""WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS path, c_custkey AS k FROM customer)
SELECT path, 'name' AS at, 'SPEC_INVALID' AS code, 'required key present' AS expected, 'missing' AS actual, CAST(NULL AS VARCHAR) AS nearest FROM c WHERE k % 5 = 0
UNION ALL SELECT path, 'size', 'SPEC_INVALID', 'int', CASE WHEN k % 3 = 1 THEN 'str' ELSE 'bool' END, NULL FROM c WHERE k % 3 > 0
UNION ALL SELECT path, 'cells[1].at', 'SPEC_INVALID', CASE WHEN k % 4 = 0 THEN 'required key present' ELSE 'str' END, CASE WHEN k % 4 = 0 THEN 'missing' ELSE 'int' END, NULL FROM c
UNION ALL SELECT path, 'cells[1].att', 'SPEC_UNKNOWN_KEY', 'known key', 'unknown key (int)', 'at' FROM c WHERE k % 4 = 0""")
def spec_problems(spark, sf_dir):
    """What is wrong with a specification for each customer."""
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, "").otherwise('"name": "x", ')
    size = F.when(k % 3 == 0, "1").when(k % 3 == 1, '"x"').otherwise("true")
    text = F.concat(F.lit("{"), name, F.lit('"size": '), size, F.lit(', "cells": [{"at": "A1"}, {"'), F.when(k % 4 == 0, "att").otherwise("at"), F.lit('": 5}]}'))
    docs = table(spark, sf_dir, "customer").select(k.cast("string").alias("path"), F.try_parse_json(text).alias("value"))
    return problems(docs, schema_rows(spark, SPEC), "spec", strict=True)
