"""Queries over document maps: ten sheets of five hundred orders each make a workbook."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.maps import document_maps
from .registry import query, table

_VERSION = "v7"
_COLUMNS = [(1, "Order", "order", "integer", "0"), (2, "Status", "status", "string", None), (3, 'Price "net"', "price net", "decimal", "#,##0.00")]
_REGIONS = [("header", 1, 1), ("data", 2, 501)]

_SQL_COLUMNS = ",".join(f'["{chr(64 + c)}","{n}","{t}",' + (f'"{f}"' if f else "null") + "]" for c, _, n, t, f in _COLUMNS)
_SQL_REGIONS = ",".join(f'["{t}","A{a}:C{b}"]' for t, a, b in _REGIONS)
_SQL_LABELS = ",".join(f'["{chr(64 + c)}","{n}"]' for c, _, n, *_ in _COLUMNS)


def _facts(spark, sf_dir) -> dict:
    key = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("B"), F.floor(key / 5000).cast("string")).alias("book"), F.concat(F.lit("S"), F.floor(key / 500).cast("string")).alias("sheet"), (F.floor(key / 500) % 10).cast("int").alias("pos"), (key % 500 + 2).cast("int").alias("row"), "o_orderpriority", "o_orderstatus")
    sheets = o.groupBy("book", "sheet", "pos").agg(F.max("row").alias("last"))
    none = lambda kind: F.lit(None).cast(kind)
    regions = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(f"A{a}:C{b}").alias("ref"), F.lit(a).alias("first_row"), F.lit(b).alias("last_row")) for t, a, b in _REGIONS])
    columns = F.array(*[F.struct(F.lit(c).alias("col"), F.lit(h).alias("header"), F.lit(n).alias("norm"), F.lit(t).alias("type"), F.lit(f).cast("string").alias("number_format"), none("string").alias("role")) for c, h, n, t, f in _COLUMNS])
    at = F.col("row").cast("string")
    merges = o.where("o_orderpriority = '1-URGENT'").select("book", "sheet", F.lit("merge").alias("kind"), none("string").alias("name"), F.concat(F.lit("A"), at, F.lit(":B"), at).alias("ref"))
    hidden = o.where("o_orderpriority = '5-LOW' and row % 7 = 0").select("book", "sheet", F.lit("hidden_row").alias("kind"), none("string").alias("name"), at.alias("ref"))
    names = sheets.select("book", "sheet", F.lit("defined_name").alias("kind"), F.concat(F.lit("n_"), "sheet").alias("name"), none("string").alias("ref"))
    return {
        "sheets": sheets.select("book", "sheet", "pos", F.lit("visible").alias("visibility"), F.concat(F.lit("A1:C"), F.col("last").cast("string")).alias("used_range"), F.lit("A2").alias("freeze"), none("string").alias("filter")),
        "regions": sheets.select("book", "sheet", F.inline(regions)),
        "columns": sheets.select("book", "sheet", F.inline(columns)),
        "headers": sheets.select("book", "sheet", F.lit(1).alias("row"), F.inline(columns)).select("book", "sheet", "row", "col", "norm"),
        "parts": merges.unionByName(hidden).unionByName(names),
        "formulas": o.groupBy("book", "sheet", F.col("o_orderstatus").alias("kind")).agg(F.count("*").alias("n")),
        "repeated": sheets.limit(0).select("book", "sheet", none("string").alias("type"), none("string").alias("signature"), none("int").alias("occurrences"), none("int").alias("rows"), none("int").alias("first_row")),
    }


@query(f"""WITH o AS (SELECT 'B' || (o_orderkey // 5000) AS book, 'S' || (o_orderkey // 500) AS sheet, (o_orderkey // 500) % 10 AS pos, o_orderkey % 500 + 2 AS row, o_orderpriority, o_orderstatus FROM orders),
k AS (SELECT book, sheet, '{{' || string_agg('"' || kind || '":' || n, ',' ORDER BY kind) || '}}' AS kinds, sum(n) AS total FROM (SELECT book, sheet, o_orderstatus AS kind, count(*) AS n FROM o GROUP BY 1, 2, 3) GROUP BY 1, 2),
m AS (SELECT book, sheet, pos, max(row) AS last, string_agg('"A' || row || ':B' || row || '"', ',' ORDER BY 'A' || row || ':B' || row) FILTER (o_orderpriority = '1-URGENT') AS merges, string_agg(CAST(row AS VARCHAR), ',' ORDER BY row) FILTER (o_orderpriority = '5-LOW' AND row % 7 = 0) AS hidden FROM o GROUP BY 1, 2, 3),
s AS (SELECT book, sheet, pos, last, '{{"autofilter":null,"columns":[{_SQL_COLUMNS}],"conditional_formats":[],"formula_summary":{{"kinds":' || kinds || ',"total":' || total || '}},"freeze_panes":"A2","headers":[[{_SQL_LABELS}]],"hidden_columns":[],"hidden_rows":[' || coalesce(hidden, '')
  || '],"merged_cells":[' || coalesce(merges, '') || '],"name":"' || sheet || '","regions":[{_SQL_REGIONS}],"repeated_structures":[],"tables":[],"used_range":"A1:C' || last || '","validations":[],"visibility":"visible"}}' AS text FROM m JOIN k USING (book, sheet)),
b AS (SELECT book, count(*) AS n_sheets, '[' || string_agg(text, ',' ORDER BY pos, sheet) || ']' AS sheets, '[' || string_agg('"n_' || sheet || '"', ',' ORDER BY 'n_' || sheet) || ']' AS names, 'sha256:' || sha256(string_agg(sheet || '|A1:C' || last || '|', chr(31) ORDER BY sheet || '|A1:C' || last || '|')) AS structure FROM s GROUP BY 1),
c AS (SELECT *, sha256('{{"defined_names":' || names || ',"dictionary_version":"{_VERSION}","doc_map_schema":"1","sheets":' || sheets || '}}') AS content FROM b)
SELECT book, n_sheets, content AS content_identity, structure AS structure_fingerprint, sha256('{{"content_identity":"' || content || '","dictionary_version":"{_VERSION}","profile_version":"1","structure_fingerprint":"' || structure || '"}}') AS profile_id FROM c""")
def map_identities(spark, sf_dir):
    """Identities of the maps and profiles of all workbooks; the number of sheets is read out of the map itself."""
    found = document_maps(_facts(spark, sf_dir), _VERSION)
    count = F.try_variant_get(F.parse_json("map"), "$.workbook.sheet_count", "bigint")
    return found.select("book", count.alias("n_sheets"), "content_identity", "structure_fingerprint", "profile_id")
