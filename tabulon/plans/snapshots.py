"""Queries over snapshots: a sheet for every 500 orders, as it was and after changes of every kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import snapshots as S
from .registry import query, table

_KEYS = "'O' || CAST(o_orderkey // 500 AS VARCHAR) AS sheet, CAST(o_orderkey % 500 + 1 AS INT) AS row"
#: What is there before and after: a price and a status with styles, a formula, a merge for each urgent order, a name for each sheet.
_ITEMS = f"""o AS (SELECT *, {_KEYS} FROM orders),
was AS (SELECT sheet, 'value' AS kind, 'R' || row || 'C4' AS key, CAST(o_custkey AS VARCHAR) AS text FROM o
  UNION ALL SELECT sheet, 'value', 'R' || row || 'C3', o_orderstatus FROM o
  UNION ALL SELECT sheet, 'style', 'R' || row || 'C3', CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'False' END || '|||11||||||||||||' || o_orderpriority || '||' FROM o
  UNION ALL SELECT sheet, 'formula', 'R' || row || 'C8', '=D' || row || '*2' FROM o
  UNION ALL SELECT sheet, 'structure:merge', 'A' || row || ':B' || row, '' FROM o WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT DISTINCT '', 'structure:defined_name', sheet, sheet || '!A1:A500' FROM o),
now AS (SELECT sheet, 'value' AS kind, 'R' || row || 'C4' AS key, CAST(CASE WHEN o_orderkey % 97 = 0 THEN o_custkey + 1 ELSE o_custkey END AS VARCHAR) AS text FROM o WHERE o_orderkey % 101 <> 0
  UNION ALL SELECT sheet, 'value', 'R' || row || 'C3', o_orderstatus FROM o
  UNION ALL SELECT sheet, 'style', 'R' || row || 'C3', CASE WHEN o_orderstatus = 'F' AND o_orderkey % 89 <> 0 THEN 'True' ELSE 'False' END || '|||11||||||||||||' || o_orderpriority || '||' FROM o
  UNION ALL SELECT sheet, 'formula', 'R' || row || 'C8', '=D' || row || CASE WHEN o_orderkey % 83 = 0 THEN '*3' ELSE '*2' END FROM o
  UNION ALL SELECT sheet, 'structure:merge', 'A' || row || ':B' || row, '' FROM o WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 79 <> 0
  UNION ALL SELECT DISTINCT '', 'structure:defined_name', sheet, sheet || '!A1:A500' FROM o),
plan AS (SELECT sheet, 'value' AS kind, 'R' || row || 'C4' AS key FROM o WHERE o_orderkey % 97 = 0 OR o_orderkey % 103 = 0)"""


def _snapshot(orders, changed: bool):
    key = F.col("o_orderkey")
    o = orders.withColumns({"sheet": F.concat(F.lit("O"), F.floor(key / 500).cast("string")), "row": (key % 500 + 1).cast("int")})
    odd = lambda n: (key % n == 0) if changed else F.lit(False)
    no = F.lit(None).cast("string")
    bold = (F.col("o_orderstatus") == "F") & ~odd(89)
    parts = {"bold": bold, "size": F.lit(11), "number_format": F.col("o_orderpriority")}
    style = S.style_signature(F.struct(*[parts.get(c, no).alias(c) for c in S.STYLE]), {"bold": "boolean"})
    value = F.when(~odd(101), (F.col("o_custkey") + F.when(odd(97), 1).otherwise(0)).cast("string"))
    formula = F.concat(F.lit("=D"), F.col("row").cast("string"), F.when(odd(83), "*3").otherwise("*2"))
    cell = lambda c, v, f, s: F.struct(F.lit(c).alias("col"), v.alias("value"), f.alias("formula"), s.alias("style"))
    cells = o.select("sheet", "row", F.inline(F.array(cell(3, F.col("o_orderstatus"), no, style), cell(4, value, no, no), cell(8, no, formula, no))))
    row = F.col("row").cast("string")
    merges = o.where((F.col("o_orderpriority") == "1-URGENT") & ~odd(79)).select("sheet", F.lit("merge").alias("kind"), F.concat(F.lit("A"), row, F.lit(":B"), row).alias("key"), no.alias("text"))
    names = o.select("sheet").distinct().select(no.alias("sheet"), F.lit("defined_name").alias("kind"), F.col("sheet").alias("key"), F.concat("sheet", F.lit("!A1:A500")).alias("text"))
    return S.snapshot(cells, merges.unionByName(names))


def _changes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    planned = orders.where((key % 97 == 0) | (key % 103 == 0)).select(F.concat(F.lit("O"), F.floor(key / 500).cast("string")).alias("sheet"), (key % 500 + 1).cast("int").alias("row"), F.lit(4).alias("col"))
    return S.changes(_snapshot(orders, False), _snapshot(orders, True), planned)


_CHANGES = f"""{_ITEMS}, d AS (SELECT coalesce(w.sheet, n.sheet) AS sheet, coalesce(w.kind, n.kind) AS kind, coalesce(w.key, n.key) AS key, w.text AS old, n.text AS new
  FROM was w FULL JOIN now n ON w.sheet = n.sheet AND w.kind = n.kind AND w.key = n.key WHERE w.text IS DISTINCT FROM n.text),
c AS (SELECT coalesce(d.sheet, p.sheet) AS sheet, coalesce(d.kind, p.kind) AS kind, coalesce(d.key, p.key) AS key, old, new,
  CASE WHEN old IS NULL AND new IS NULL THEN NULL WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'changed' END AS change,
  CASE WHEN p.key IS NULL THEN 'unexpected' WHEN old IS NULL AND new IS NULL THEN 'noop' ELSE 'changed' END AS status
  FROM d FULL JOIN plan p ON p.sheet = d.sheet AND p.kind = d.kind AND p.key = d.key)"""


@query(f"WITH {_CHANGES} SELECT * FROM c")
def snapshot_changes(spark, sf_dir):
    """Every difference between two snapshots of all sheets, planned ones apart."""
    return _changes(spark, sf_dir)


@query(f"WITH {_CHANGES} SELECT status, kind, count(*) AS n FROM c GROUP BY 1, 2")
def snapshot_summary(spark, sf_dir):
    return S.summary(_changes(spark, sf_dir))
