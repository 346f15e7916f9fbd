"""Queries over regions and headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import is_section, looks_like_notes, summary_label
from ..operators import structure as T
from .registry import query, table


@query(r"""
WITH l AS (SELECT doc_id, CAST(i AS INT) AS line, lines[i] AS text FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)) WHERE trim(lines[i]) <> ''),
k AS (SELECT doc_id, line, CASE WHEN regexp_matches(lower(trim(text)), '^(ara toplam)') OR lower(trim(text)) IN ('sub total', 'subtotal', 'subtotals') THEN 'subtotal'
  WHEN regexp_matches(lower(trim(text)), '^(genel toplam|grand total|toplam|total|buyuk toplam$|büyük toplam$)') THEN 'total'
  WHEN length(text) <= 60 AND upper(text) = text AND lower(text) <> text AND (CASE WHEN regexp_matches(text, '[0-9]') THEN contains(text, ' ') AND length(text) >= 5 ELSE length(text) >= 4 AND regexp_full_match(text, '[\p{L} ]+') END) THEN 'section_header'
  WHEN regexp_matches(lower(trim(text)), '^(not:|not;|not |notlar|notes|note:|remark|remarks|açıklama|açıklamalar|aciklama|aciklamalar)') THEN 'notes'
  WHEN line % 11 IN (0, 1) OR line % 17 = 0 THEN 'formula_region' ELSE 'data' END AS kind FROM l),
g AS (SELECT *, coalesce(line - lag(line) OVER w > 1, true) AS gap, lag(kind) OVER w AS pk, lead(kind) OVER w AS nk, lead(line) OVER w AS nl FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
o AS (SELECT *, kind = 'formula_region' AND NOT coalesce(pk = 'formula_region' AND NOT gap, false) AND NOT coalesce(nk = 'formula_region' AND nl - line = 1, false) AS lone FROM g),
t AS (SELECT *, CASE WHEN lone THEN 'data' ELSE kind END AS type FROM o),
n AS (SELECT *, CASE WHEN gap OR type IS DISTINCT FROM lag(type) OVER w OR type IN ('section_header', 'subtotal', 'total') OR coalesce(lag(lone) OVER w, false) THEN 1 ELSE 0 END AS new FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line) AS region FROM n)
SELECT doc_id, type, min(line) AS first_row, max(line) AS last_row, count(*) AS n_rows, CASE type WHEN 'data' THEN 'record_block' WHEN 'notes' THEN 'note_block' WHEN 'section_header' THEN 'section_block' WHEN 'total' THEN 'total_block' WHEN 'subtotal' THEN 'subtotal_block' END AS block,
  'rows:' || count(*) || CASE WHEN bool_or(lone) THEN ';lone_formula_row' ELSE '' END AS evidence FROM r GROUP BY doc_id, region, type""")
def regions(spark, sf_dir):
    """Lines of documents as rows of sheets; some are taken for formula rows."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1).where("trim(text) <> ''")
    low, line = F.lower(F.trim("text")), F.col("line")
    formula = F.when(((line % 11).isin(0, 1)) | (line % 17 == 0), 1).otherwise(0)
    rows = lines.withColumns({"formula": formula, "nonempty": F.lit(2)})
    rows = rows.withColumn("kind", T.row_class(summary_label(low), is_section(F.col("text"), F.lit(False)), looks_like_notes(low)))
    return T.regions(rows.select("doc_id", "line", "kind"), ["doc_id"], "line", "kind")


@query("""
WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS row, event_type, value, props, event_id FROM events),
c AS (SELECT user_id, row, CASE WHEN row % 9 = 1 THEN 4 ELSE 3 END AS nonempty, CASE WHEN row % 9 = 1 THEN 4 ELSE 2 END AS text, CASE WHEN row % 9 = 1 THEN 0 ELSE 1 END AS num, CASE WHEN row % 9 = 1 THEN 4 ELSE 3 END AS last_col, CASE WHEN row % 9 = 1 THEN 4 ELSE CASE WHEN event_type = 'view' THEN 2 ELSE 3 END END AS n_distinct FROM p),
w AS (SELECT *, max(last_col) OVER (PARTITION BY user_id) AS width, coalesce(lead(num) OVER (PARTITION BY user_id ORDER BY row), 0) AS next_num FROM c),
s AS (SELECT *, nonempty >= 2 AND text >= 0.8 * nonempty AS a, nonempty >= 0.8 * width AS b, num = 0 AND next_num > 0 AS d, nonempty >= 2 AND n_distinct = nonempty AS e, row <= 3 AS f FROM w)
SELECT user_id, CAST(row AS INT) AS row, CAST(greatest(0, x) AS INT) AS score, x >= 55 AS accepted, array_to_string(list_sort(list_filter([CASE WHEN a THEN 'text' END, CASE WHEN b THEN 'filled' END, CASE WHEN d THEN 'types_change' END, CASE WHEN e THEN 'unique' END, CASE WHEN f THEN 'early' END], lambda v: v IS NOT NULL)), ';') AS evidence
FROM (SELECT *, CASE WHEN a THEN 30 ELSE 0 END + CASE WHEN b THEN 20 ELSE 0 END + CASE WHEN d THEN 20 ELSE 0 END + CASE WHEN e THEN 10 ELSE 0 END + CASE WHEN f THEN 8 ELSE 0 END - CASE WHEN nonempty < 0.5 * width THEN 20 ELSE 0 END AS x FROM s)""")
def header_scores(spark, sf_dir):
    """Each user's events as the rows of a sheet, every ninth of which is four labels."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("row", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    head = F.col("row") % 9 == 1
    pick = lambda a, b: F.when(head, a).otherwise(b)
    rows = e.select(
        "user_id", "row", pick(4, 3).alias("nonempty"), pick(4, 2).alias("text"), pick(0, 1).alias("num"), pick(4, 3).alias("last_col"),
        pick(F.lit(4), F.when(F.col("event_type") == "view", 2).otherwise(3)).alias("n_distinct"),
    )
    return T.header_scores(rows, ["user_id"], "row")
