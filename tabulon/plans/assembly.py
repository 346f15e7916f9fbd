"""Queries over sheets put together from rows: each order is a row, five hundred make a sheet."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.refs import index_to_col
from ..operators import assembly as A
from ..operators import documents as D
from .registry import query, table

TYPES = ["header", "data", "notes", "total", "data"]

_ROWS = "SELECT 'O' || CAST(o_orderkey // 500 AS VARCHAR) AS sheet, CAST(o_orderkey % 500 + 1 AS INT) AS row, CAST(1 + o_custkey % 3 AS INT) AS a, CAST(1 + o_custkey % 3 + o_orderkey % 5 AS INT) AS b, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 + o_custkey % 4 END AS nonempty FROM orders"


def _rows(spark, sf_dir):
    key, left = F.col("o_orderkey"), (1 + F.col("o_custkey") % 3).cast("int")
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("O"), F.floor(key / 500).cast("string")).alias("sheet"), (key % 500 + 1).cast("int").alias("row"), left.alias("first_col"), (left + key % 5).cast("int").alias("last_col"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1 + F.col("o_custkey") % 4).alias("nonempty"))
    return o.withColumns({c: F.when(F.col("nonempty") > 0, F.col(c)) for c in ("first_col", "last_col")})


def _regions(spark, sf_dir):
    kinds = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(100 * i + 1).alias("first_row"), F.lit(100 * i + 100).alias("last_row")) for i, t in enumerate(TYPES)])
    return _rows(spark, sf_dir).select("sheet").distinct().select("sheet", F.inline(kinds))


@query(f"""WITH r AS ({_ROWS}), d AS (SELECT sheet, min(row) AS r0, max(row) AS r1, min(a) AS c0, max(b) AS c1 FROM r WHERE nonempty > 0 GROUP BY 1)
SELECT sheet, chr(64 + c0) || r0 || ':' || chr(64 + c1) || r1 AS used_range, r1 AS true_max_row, c1 AS true_max_column FROM d""")
def sheet_dimensions(spark, sf_dir):
    return A.dimensions(_rows(spark, sf_dir))


_TYPE = "list_value(" + ", ".join(f"'{t}'" for t in TYPES) + ")[(row - 1) // 100 + 1]"


@query(f"""WITH r AS ({_ROWS}), c AS (SELECT sheet, unnest(range(a, b + 1)) AS col, {_TYPE} AS type, 100 * ((row - 1) // 100) + 1 AS start FROM r WHERE nonempty > 0),
n AS (SELECT sheet, col, type, count(*) AS n, min(start) AS start FROM c GROUP BY 1, 2, 3)
SELECT sheet, CAST(col AS INT) AS col, arg_min(type, (-n, start)) AS region FROM n GROUP BY 1, 2""")
def column_regions(spark, sf_dir):
    """The region that covers most rows of each column."""
    return A.column_regions(_rows(spark, sf_dir), _regions(spark, sf_dir))


@query(f"""WITH r AS ({_ROWS}), c AS (SELECT sheet, unnest(range(a, b + 1)) AS col, {_TYPE} AS type, 100 * ((row - 1) // 100) + 1 AS start FROM r WHERE nonempty > 0),
n AS (SELECT sheet, col, type, count(*) AS n, min(start) AS start FROM c GROUP BY 1, 2, 3), k AS (SELECT sheet, chr(CAST(64 + col AS INT)) AS letter, arg_min(type, (-n, start)) AS region FROM n GROUP BY 1, 2),
w AS (SELECT DISTINCT 'O' || CAST(o_orderkey // 500 AS VARCHAR) AS sheet, chr(CAST(65 + o_custkey % 12 AS INT)) AS letter FROM orders)
SELECT w.sheet, w.letter, k.sheet IS NOT NULL AS found, region FROM w LEFT JOIN k ON k.sheet = w.sheet AND k.letter = w.letter""")
def located_columns(spark, sf_dir):
    """Columns that are asked for by letter, with the region that each is known by."""
    asked = table(spark, sf_dir, "orders").select(F.concat(F.lit("O"), F.floor(F.col("o_orderkey") / 500).cast("string")).alias("sheet"), index_to_col((F.col("o_custkey") % 12 + 1).cast("int")).alias("letter")).distinct()
    known = A.column_regions(_rows(spark, sf_dir), _regions(spark, sf_dir)).select("sheet", index_to_col(F.col("col")).alias("letter"), "region")
    return A.located(asked, known, ["sheet", "letter"])


@query(f"""WITH r AS ({_ROWS}), s AS (SELECT sheet, 50 * ((row - 1) // 50) + 1 AS first_row, min(CASE WHEN nonempty > 0 THEN a END) AS min_col, max(CASE WHEN nonempty > 0 THEN b END) AS max_col FROM r GROUP BY 1, 2),
e AS (SELECT DISTINCT sheet, unnest(range(1, 500, 50)) AS first_row FROM r)
SELECT e.sheet, CAST(e.first_row AS INT) AS first_row, coalesce(max_col, 0) AS width, min_col, CASE WHEN min_col IS NOT NULL THEN chr(64 + min_col) || e.first_row || ':' || chr(64 + max_col) || (e.first_row + 49) END AS ref FROM e LEFT JOIN s USING (sheet, first_row)""")
def row_spans(spark, sf_dir):
    """What every fifty rows of a sheet use."""
    rows = _rows(spark, sf_dir)
    starts = F.explode(F.array(*[F.lit(i) for i in range(1, 500, 50)])).alias("first_row")
    ranges = rows.select("sheet").distinct().select("sheet", starts).withColumn("last_row", F.col("first_row") + 49)
    return A.spans(rows, ranges).select("sheet", "first_row", "width", "min_col", "ref")


@query(f"""WITH r AS ({_ROWS}), q AS (SELECT sheet, row || '|' || a || '|' || b AS part FROM r), p AS (SELECT sheet, string_agg(part, chr(31) ORDER BY part) AS t FROM q GROUP BY 1) SELECT sheet, 'sha256:' || sha256(t) AS fingerprint FROM p""")
def structure_fingerprints(spark, sf_dir):
    """Order-free identity of each sheet's rows and spans."""
    key, left = F.col("o_orderkey"), 1 + F.col("o_custkey") % 3
    part = F.concat_ws("|", (key % 500 + 1).cast("string"), left.cast("string"), (left + key % 5).cast("string"))
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("O"), F.floor(key / 500).cast("string")).alias("sheet"), part.alias("part"))
    return A.structure_fingerprint(rows, ["sheet"], "part")


@query("""SELECT conv_id, turn, replace(coalesce(text, ''), 'the ', 'THE ') AS text, CAST((length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'the ', ''))) // 4 AS BIGINT) AS n FROM conversations""")
def replaced_text(spark, sf_dir):
    """A word replaced in every turn, each a paragraph of one run."""
    runs = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit(1).alias("run"), F.coalesce("text", F.lit("")).alias("text"))
    return D.replace_text(runs, ["conv_id", "turn"], "run", "the ", "THE ").drop("run")
