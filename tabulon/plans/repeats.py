"""Queries over what repeats in sheets: each supplier's line items by ship date are the rows of a sheet, with zeros and N as empty cells."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import normalize_header
from ..operators import repeats as R
from .registry import dealt, query, table

_BODY = """i AS (SELECT l_suppkey AS sheet, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS row,
  CASE WHEN l_returnflag = 'N' THEN '.' ELSE 't' END || CASE WHEN l_discount < 0.03 THEN '.' ELSE 'n' END || CASE WHEN l_tax < 0.03 THEN '.' ELSE 'n' END AS sig FROM lineitem),
f AS (SELECT *, row - row_number() OVER (PARTITION BY sheet ORDER BY row) AS run FROM i WHERE sig <> '...'),
b AS (SELECT sheet, run, min(row) AS band, max(length(rtrim(sig, '.'))) AS width FROM f GROUP BY 1, 2 HAVING count(*) >= 3),
s AS (SELECT sheet, CAST(band AS INT) AS band, CAST(row AS INT) AS row, row - band AS place, left(sig, width) AS sig, sig AS whole FROM f JOIN b USING (sheet, run)),
c AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY sheet, band ORDER BY row) AS block FROM (SELECT *, sig IS DISTINCT FROM lag(sig) OVER (PARTITION BY sheet, band ORDER BY row) AS new FROM s))"""


def _rows(spark, sf_dir):
    blank = lambda empty, letter: F.when(empty, ".").otherwise(letter)
    sig = F.concat(blank(F.col("l_returnflag") == "N", "t"), blank(F.col("l_discount") < 0.03, "n"), blank(F.col("l_tax") < 0.03, "n"))
    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    lines = table(spark, sf_dir, "lineitem")
    rows = dealt(lines.select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", sig.alias("full")), lines.count(), "l_suppkey")
    rows = rows.select(F.col("l_suppkey").alias("sheet"), F.row_number().over(order).alias("row"), "full")
    bare = F.rtrim("full", F.lit("."))
    first = F.when(F.length(bare) > 0, F.length(bare) - F.length(F.ltrim(bare, F.lit("."))) + 1)
    return rows.select("sheet", "row", F.length(F.replace("full", F.lit("."), F.lit(""))).alias("nonempty"), first.alias("first_col"), F.when(F.length(bare) > 0, F.length(bare)).alias("last_col"), bare.alias("sig"))


@query(f"""WITH {_BODY}, r AS (SELECT sheet, band, block, sig, min(row) AS first_row, max(row) AS last_row, min(length(whole) - length(ltrim(whole, '.')) + 1) AS a, max(length(rtrim(whole, '.'))) AS z FROM c GROUP BY 1, 2, 3, 4),
n AS (SELECT *, count(*) OVER w AS occurrences, first_value(last_row - first_row + 1) OVER (w ORDER BY first_row) AS rows_per_run FROM r WINDOW w AS (PARTITION BY sheet, band, sig))
SELECT sheet, band, sig AS signature, first_row, last_row, chr(CAST(64 + a AS INT)) || first_row || ':' || chr(CAST(64 + z AS INT)) || last_row AS ref, occurrences, rows_per_run, score, CASE score WHEN 80 THEN 'HIGH' WHEN 65 THEN 'MEDIUM' ELSE 'LOW' END AS level
FROM (SELECT *, CASE WHEN 5 * length(replace(replace(sig, 't', ''), 'n', '')) > 3 * length(sig) THEN 45 WHEN occurrences >= 3 THEN 80 ELSE 65 END AS score FROM n WHERE occurrences > 1)""")
def repeated_blocks(spark, sf_dir):
    """Runs of rows with one signature that come again in their band."""
    return R.repeated_blocks(_rows(spark, sf_dir))


@query(f"""WITH {_BODY}, n AS (SELECT sheet, band, sig, count(DISTINCT block) AS occurrences, arg_min(k, block) AS rows_per_run FROM (SELECT sheet, band, sig, block, count(*) AS k FROM c GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)
SELECT sheet, band, 'p' || sig AS block_id, 'repeated_pattern' AS archetype, 'record_row' AS row_archetype, occurrences, rows_per_run, score, CASE score WHEN 80 THEN 'HIGH' WHEN 65 THEN 'MEDIUM' ELSE 'LOW' END AS level, 'repeated_type:repeated_row_block;occurrences:' || occurrences || ';signature:' || sig AS evidence
FROM (SELECT *, CASE WHEN 5 * length(replace(replace(sig, 't', ''), 'n', '')) > 3 * length(sig) THEN 45 WHEN occurrences >= 3 THEN 80 ELSE 65 END AS score FROM n WHERE occurrences > 1)""")
def pattern_blocks(spark, sf_dir):
    """What comes again as blocks of a sheet."""
    return R.pattern_blocks(R.repeated_blocks(_rows(spark, sf_dir)))


def _reported() -> str:
    """Smaller periods first: a stretch is reported if some row of it is in none reported before."""
    out = ["r2 AS (SELECT * FROM m WHERE p = 2)"]
    for p in (3, 4, 5, 6):
        before = f"SELECT DISTINCT sheet, band, unnest(range(a, z + 1)) AS x FROM r{p - 1}"
        own = f"SELECT sheet, band, unnest(range(a, z + 1)) AS x FROM m WHERE p = {p}"
        out.append(f"k{p} AS (SELECT DISTINCT sheet, band FROM (SELECT * FROM ({own}) EXCEPT SELECT * FROM ({before})))")
        out.append(f"r{p} AS (SELECT * FROM r{p - 1} UNION ALL SELECT * FROM m WHERE p = {p} AND (sheet, band) IN (SELECT (sheet, band) FROM k{p}))")
    return ", ".join(out)


@query(f"""WITH RECURSIVE {_BODY}, d AS (SELECT sheet, band, place, row, sig, block, unnest([2, 3, 4, 5, 6]) AS p, count(*) OVER (PARTITION BY sheet, band) AS n FROM c),
e AS (SELECT d.*, d.sig IS DISTINCT FROM o.sig AS bad FROM d LEFT JOIN s o ON o.sheet = d.sheet AND o.band = d.band AND o.place = d.place - d.p),
g AS (SELECT *, min(CASE WHEN bad THEN place END) OVER (PARTITION BY sheet, band, p ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM e),
h AS (SELECT u.sheet, u.band, u.p, u.place AS a, coalesce(v.stop, u.n) - 1 AS z FROM g u JOIN g v ON v.sheet = u.sheet AND v.band = u.band AND v.p = u.p AND v.place = u.place + u.p WHERE coalesce(v.stop, u.n) - u.place >= 2 * u.p),
t AS (SELECT h.* FROM h JOIN (SELECT sheet, band, p, min(a) AS a FROM h GROUP BY 1, 2, 3) USING (sheet, band, p, a)
  UNION ALL SELECT sheet, band, p, a, z FROM (SELECT h.*, row_number() OVER (PARTITION BY h.sheet, h.band, h.p ORDER BY h.a) AS k FROM t JOIN h ON h.sheet = t.sheet AND h.band = t.band AND h.p = t.p AND h.a > t.z) WHERE k = 1),
l AS (SELECT sheet, band, p, arg_min(a, (a - z, a)) AS a, arg_min(z, (a - z, a)) AS z FROM t GROUP BY 1, 2, 3),
m AS (SELECT l.*, string_agg(c.sig, ' / ' ORDER BY place) FILTER (WHERE place < a + p) AS unit FROM l JOIN c ON c.sheet = l.sheet AND c.band = l.band AND place BETWEEN a AND z GROUP BY ALL HAVING count(DISTINCT c.sig) > 1), {_reported()}
SELECT sheet, band, p AS period, CAST(band + a AS INT) AS first_row, CAST(band + z AS INT) AS last_row, unit, CAST((z - a + 1) // p AS INT) AS occurrences, z - a + 1 AS covered, CASE WHEN (z - a + 1) // p >= 3 THEN 80 ELSE 65 END AS score, CASE WHEN (z - a + 1) // p >= 3 THEN 'HIGH' ELSE 'MEDIUM' END AS level FROM r6""")
def repeated_periods(spark, sf_dir):
    """The longest stretch of each band and period, smallest periods first."""
    return R.periods(_rows(spark, sf_dir))


@query("""WITH l AS (SELECT o_custkey AS sheet, o_orderkey AS row, unnest([1, 2, 3]) AS col, unnest([lower(replace(o_orderpriority, '-', ' ')), CASE WHEN o_orderstatus <> 'O' THEN lower(o_orderstatus) END, CAST(year(o_orderdate) AS VARCHAR)]) AS label FROM orders),
n AS (SELECT sheet, row, col, trim(regexp_replace(label, ' +', ' ', 'g')) AS label FROM l WHERE label IS NOT NULL),
q AS (SELECT a.sheet, a.row, b.row AS earlier, count(*) AS n, count_if(a.label = b.label) AS k FROM n a JOIN n b ON a.sheet = b.sheet AND a.col = b.col AND b.row < a.row GROUP BY 1, 2, 3),
r AS (SELECT sheet, row, min(earlier) AS repeats FROM q WHERE k > 0 AND k >= 0.6 * n GROUP BY 1, 2)
SELECT sheet, row, repeats, CAST(1 + row_number() OVER (PARTITION BY sheet, repeats ORDER BY row) AS INT) AS occurrence, 80 AS score, 'HIGH' AS level FROM r""")
def repeated_headers(spark, sf_dir):
    """Each customer's orders as headers of a sheet: priority, status (O: none) and year."""
    status = F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus"))
    labels = F.array("o_orderpriority", status, F.year("o_orderdate").cast("string"))
    cells = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sheet"), F.col("o_orderkey").alias("row"), F.posexplode(labels).alias("i", "label"))
    return R.repeated_headers(cells.select("sheet", "row", (F.col("i") + 1).alias("col"), normalize_header(F.col("label")).alias("label")))
