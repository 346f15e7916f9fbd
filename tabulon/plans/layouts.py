"""Queries over column roles, matching, mapping and execution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import matching as M
from ..operators import profile as P
from ..operators import semantics as K
from ..operators import transactions as X
from ..operators.report import match_report as match
from ..sources.rounds import stored
from .registry import query, table

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}
COLUMNS = {
    "region": [("r_regionkey", "integer"), ("r_name", "string")],
    "nation": [("n_nationkey", "integer"), ("n_name", "string"), ("n_regionkey", "integer")],
    "customer": [("c_custkey", "integer"), ("c_name", "string"), ("c_nationkey", "integer"), ("c_acctbal", "decimal"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "integer"), ("s_name", "string"), ("s_nationkey", "integer"), ("s_acctbal", "decimal")],
    "part": [("p_partkey", "integer"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "integer"), ("p_retailprice", "decimal")],
    "orders": [("o_orderkey", "integer"), ("o_custkey", "integer"), ("o_orderstatus", "string"), ("o_totalprice", "decimal"), ("o_orderdate", "datetime"), ("o_orderpriority", "string")],
}


def _columns(spark, sf_dir, sheets=tuple(COLUMNS)):
    """Profiles of the columns of up to six tables; norm is the header without its table's letter."""
    parts = [P.typed_profile(table(spark, sf_dir, t), t, [c for c, _ in COLUMNS[t]]) for t in sheets]
    columns = reduce(lambda a, b: a.unionByName(b), parts).withColumn("norm", F.regexp_replace("header", "^[a-z]_", ""))
    # one row for each column of the schemas, never of the data: read back rather than planned again for every use
    return spark.createDataFrame(columns.toArrow(), columns.schema)


def _labelled(spark, sf_dir, sheets=tuple(COLUMNS)):
    """The profiles with the role decided for each column."""
    columns = _columns(spark, sf_dir, sheets)
    roles = K.decide(K.role_scores(K.evidence(columns, K.dictionary(spark))), ["sheet", "col"], "role")
    return columns.join(roles.select("sheet", "col", "role"), ["sheet", "col"]).withColumn("number_format", F.lit(None).cast("string"))


_COLUMNS = " UNION ALL ".join(
    f"SELECT '{t}' AS sheet, {i + 1} AS col, '{c}' AS header, '{kind}' AS type, count(*) AS n_cells, count({c}) AS non_null, count(DISTINCT {'printf(\'%.4f\', ' + c + ')' if kind == 'decimal' else c}) AS n_distinct, '{c[2:]}' AS norm FROM {t}"
    for t, cols in COLUMNS.items()
    for i, (c, kind) in enumerate(cols)
)
_TERMS = "(VALUES " + ", ".join(f"('{w}', '{r}')" for w, r in {w: r for r, ws in reversed(K.TERMS.items()) for w in reversed(ws)}.items()) + ") terms(term, role)"
_KINDS = "(VALUES " + ", ".join(f"('{k}', '{r}', {w})" for k, rs in K.AFFINITY.items() for r, w in rs.items()) + ") kinds(type, role, weight)"
_first = lambda words: "CASE " + " ".join(f"WHEN contains(norm, '{w}') THEN '{w}'" for w in words) + " END"
_KEYWORDS = " ".join(f"UNION ALL SELECT sheet, col, '{K.FAMILIES[k][0]}', {K.FAMILIES[k][1]}, 'keyword:{k}:' || {_first(ws)} FROM cols WHERE {_first(ws)} IS NOT NULL" for k, ws in K.KEYWORDS.items())
_SCORES = f"""cols AS ({_COLUMNS}),
ev AS (SELECT sheet, col, role, CASE WHEN norm = term THEN 45 WHEN contains(norm, term) AND length(term) >= 3 THEN 25 WHEN contains(term, norm) AND length(norm) >= 5 THEN 12 END AS weight, 'header:' || term AS reason
         FROM cols, {_TERMS} WHERE contains(norm, term) OR contains(term, norm)
       {_KEYWORDS}
       UNION ALL SELECT sheet, col, role, weight, 'kind:' || cols.type FROM cols JOIN {_KINDS} ON kinds.type = cols.type
       UNION ALL SELECT sheet, col, 'identifier', 15, 'values:distinct' FROM cols WHERE type = 'string' AND n_cells >= 3 AND n_distinct >= 0.9 * n_cells),
scores AS (SELECT sheet, col, role, CAST(least(100, sum(weight)) AS INT) AS score, string_agg(DISTINCT reason, ';' ORDER BY reason) AS evidence FROM ev WHERE weight IS NOT NULL GROUP BY 1, 2, 3)"""
_ROLES = f"""{_SCORES},
ranked AS (SELECT *, lead(score) OVER w AS second, row_number() OVER w AS r FROM scores WINDOW w AS (PARTITION BY sheet, col ORDER BY score DESC, role)),
roles AS (SELECT sheet, col, role, score, second, CASE WHEN score >= 80 THEN 'HIGH' WHEN score >= 65 THEN 'MEDIUM' ELSE 'LOW' END AS level, score - coalesce(second, 0) AS margin, second IS NOT NULL AND score - second < 10 AS requires_review FROM ranked WHERE r = 1)"""


def _scores(spark, sf_dir):
    return K.role_scores(K.evidence(_columns(spark, sf_dir), K.dictionary(spark)))


def _roles(spark, sf_dir):
    return K.decide(_scores(spark, sf_dir), ["sheet", "col"], "role")


@query(f"WITH {_SCORES} SELECT * FROM scores")
def role_scores(spark, sf_dir):
    return _scores(spark, sf_dir)


@query(f"WITH {_ROLES} SELECT * FROM roles")
def role_decision(spark, sf_dir):
    return _roles(spark, sf_dir)


@query(f"""WITH {_ROLES} SELECT sheet, col, header, CAST(CASE WHEN role = 'identifier' THEN 40 ELSE 0 END + CASE WHEN n_distinct = non_null THEN 25 ELSE floor(15 * (n_distinct / greatest(non_null, 1))) END
 + CASE WHEN non_null = n_cells THEN 15 ELSE 0 END + 5 AS INT) AS score, non_null - n_distinct AS duplicates FROM cols JOIN roles USING (sheet, col)""")
def key_candidates(spark, sf_dir):
    return K.key_score(_labelled(spark, sf_dir))


_UNITS = "CASE WHEN type IN ('integer', 'decimal') THEN CASE WHEN norm IN ('totalprice', 'retailprice', 'acctbal', 'price') THEN '$' END END"


@query(f"WITH cols AS ({_COLUMNS}) SELECT sheet, col, header, {_UNITS} AS unit FROM cols")
def unit_guess(spark, sf_dir):
    return _columns(spark, sf_dir).select("sheet", "col", "header", K.unit_guess(F.col("norm"), F.col("type")).alias("unit"))


PAIRS = [("customer", "supplier"), ("orders", "customer"), ("nation", "region"), ("part", "orders")]
_PAIRS = "(VALUES " + ", ".join(f"('{t}>{i}', '{t}', '{i}')" for t, i in PAIRS) + ") pairs(pair, t, i)"
_PAIR_SCORES = f"""{_ROLES}, c AS (SELECT cols.*, role FROM cols JOIN roles USING (sheet, col)),
ps AS (SELECT pair, a.col AS t_col, b.col AS i_col, CAST(least(100, CASE WHEN a.norm = b.norm THEN 55 ELSE 0 END + CASE WHEN a.role = b.role THEN 25 ELSE 0 END + CASE WHEN a.type = b.type THEN 12 ELSE 0 END + 8 + CASE WHEN a.col = b.col THEN 5 ELSE 0 END) AS INT) AS score
  FROM {_PAIRS} JOIN c a ON a.sheet = t JOIN c b ON b.sheet = i)"""


def _pair_scores(spark, sf_dir):
    c = _labelled(spark, sf_dir)
    pairs = spark.createDataFrame([(f"{t}>{i}", t, i) for t, i in PAIRS], "pair string, t string, i string")
    side = lambda k: c.join(F.broadcast(pairs), F.col("sheet") == F.col(k))
    return M.pair_scores(side("t"), side("i"))


@query(f"WITH {_PAIR_SCORES} SELECT * FROM ps")
def column_match_scores(spark, sf_dir):
    return _pair_scores(spark, sf_dir)


_GREEDY = f"""{_PAIR_SCORES}, steps AS (SELECT pair, t_col, row_number() OVER (PARTITION BY pair ORDER BY t_col) AS k FROM (SELECT DISTINCT pair, t_col FROM ps)),
walk AS (
  SELECT DISTINCT pair, CAST(0 AS BIGINT) AS k, CAST(NULL AS INT) AS t_col, CAST(NULL AS INT) AS i_col, CAST(NULL AS INT) AS score, CAST(NULL AS INT) AS second_score, CAST([] AS INT[]) AS used FROM ps
  UNION ALL
  SELECT w.pair, s.k, s.t_col, CASE WHEN f.x[1].score >= 30 THEN f.x[1].i_col END, CASE WHEN f.x[1].score >= 30 THEN f.x[1].score END, CASE WHEN f.x[1].score >= 30 THEN f.x[2].score END,
         CASE WHEN f.x[1].score >= 30 THEN list_append(w.used, f.x[1].i_col) ELSE w.used END
  FROM walk w JOIN steps s ON s.pair = w.pair AND s.k = w.k + 1,
  LATERAL (SELECT list({{'score': ps.score, 'i_col': ps.i_col}} ORDER BY ps.score DESC, ps.i_col) AS x FROM ps WHERE ps.pair = s.pair AND ps.t_col = s.t_col AND NOT list_contains(w.used, ps.i_col)) f),
matched AS (SELECT pair, t_col, i_col, score, second_score FROM walk WHERE k > 0)"""


@query(f"WITH RECURSIVE {_GREEDY} SELECT * FROM matched")
def column_match_greedy(spark, sf_dir):
    return M.greedy(_pair_scores(spark, sf_dir))


@query(f"WITH RECURSIVE {_GREEDY} SELECT ps.pair, ps.i_col, m.t_col AS owner, ps.t_col AS rival, ps.score AS rival_score FROM ps JOIN matched m ON m.pair = ps.pair AND m.i_col = ps.i_col WHERE ps.t_col <> m.t_col AND m.score - ps.score < 10")
def rival_columns(spark, sf_dir):
    scores = _pair_scores(spark, sf_dir)
    return M.rivals(scores, M.greedy(scores))


@query(f"""WITH c AS ({_COLUMNS}), o AS (SELECT a.sheet, b.sheet AS other, count(*) AS overlap FROM c a JOIN c b ON a.norm = b.norm AND a.sheet <> b.sheet GROUP BY 1, 2)
SELECT sheet, arg_min(other, (-overlap, other)) AS other, max(overlap) AS overlap FROM o GROUP BY sheet""")
def sheet_pairing(spark, sf_dir):
    """For each table, the other one that shares most headers."""
    c = _columns(spark, sf_dir).select("sheet", "norm")
    o = c.join(c.select(F.col("sheet").alias("other"), "norm"), "norm").where("sheet <> other").groupBy("sheet", "other").agg(F.count("*").alias("overlap"))
    return o.groupBy("sheet").agg(F.min(F.struct((-F.col("overlap")).alias("n"), "other")).alias("x")).select("sheet", "x.other", (-F.col("x.n")).alias("overlap"))


#: (sheet, the table whose columns it has) of a template and of an instance, in order.
BOOKS = {"t": [("customer", "customer"), ("supplier", "supplier"), ("nation", "nation"), ("orders", "orders"), ("region", "region")], "i": [("customer", "supplier"), ("places", "region"), ("sales", "orders"), ("extra", "part")]}
_BOOK = lambda k: "(VALUES " + ", ".join(f"({n}, '{s}', '{t}')" for n, (s, t) in enumerate(BOOKS[k])) + f") {k}(pos, sheet, src)"
_OPEN = lambda k: f"SELECT * FROM {_BOOK(k)} WHERE sheet NOT IN (SELECT sheet FROM {_BOOK('i' if k == 't' else 't')})"
_SHEET_PAIRS = f"""hd AS ({_COLUMNS}), ot AS ({_OPEN("t")}), oi AS ({_OPEN("i")}),
ov AS (SELECT ot.pos AS tp, oi.pos AS ip, count(*) AS overlap FROM ot JOIN hd a ON a.sheet = ot.src JOIN hd b ON b.norm = a.norm JOIN oi ON oi.src = b.sheet GROUP BY 1, 2),
st AS (SELECT pos, row_number() OVER (ORDER BY pos) AS k FROM ot),
sw AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS INT) AS tp, CAST(NULL AS INT) AS ip, CAST(NULL AS BIGINT) AS overlap, CAST([] AS INT[]) AS used
  UNION ALL SELECT st.k, st.pos, f.x[1].ip, f.x[1].overlap, CASE WHEN f.x[1].ip IS NULL THEN w.used ELSE list_append(w.used, f.x[1].ip) END FROM sw w JOIN st ON st.k = w.k + 1,
  LATERAL (SELECT list({{'overlap': ov.overlap, 'ip': ov.ip}} ORDER BY ov.overlap DESC, ov.ip) AS x FROM ov WHERE ov.tp = st.pos AND NOT list_contains(w.used, ov.ip)) f),
sp AS (SELECT t.sheet AS t_sheet, i.sheet AS i_sheet, t.src AS t, i.src AS i, 'name' AS how FROM {_BOOK("t")} JOIN {_BOOK("i")} ON i.sheet = t.sheet
  UNION ALL SELECT t.sheet, i.sheet, t.src, i.src, CASE WHEN i.sheet IS NOT NULL THEN 'headers' END FROM sw JOIN {_BOOK("t")} ON t.pos = sw.tp LEFT JOIN {_BOOK("i")} ON i.pos = sw.ip WHERE k > 0),
spairs AS (SELECT t_sheet AS pair, t, i FROM sp WHERE i IS NOT NULL)"""
_REPORT = f"""{_SHEET_PAIRS}, {_GREEDY.replace(_PAIRS, "spairs pairs")},
sz AS (SELECT sheet, count(*) AS width, max(n_cells) AS height FROM hd GROUP BY 1),
cs AS (SELECT pair, CAST(floor(100 * count(i_col) / count(*)) AS INT) AS column_score, bool_or(coalesce(score - second_score < 10, false)) AS near FROM matched GROUP BY 1),
rp AS (SELECT t_sheet, i_sheet, how, CASE WHEN a.height >= 1000 AND b.height < 1000 THEN 66 ELSE 100 END AS region_score, column_score,
    CAST(100 - floor(100 * abs(a.width - b.width) / (a.width + b.width)) AS INT) AS formula_score, CASE WHEN t_sheet = i_sheet THEN 100 ELSE 91 END AS structural_score, near
  FROM sp JOIN sz a ON a.sheet = t JOIN sz b ON b.sheet = i JOIN cs ON cs.pair = t_sheet)"""


def _books(spark, sf_dir):
    """Both workbooks: columns with roles; formulas by kind, as many as columns; a header, a body and, for 1,000 rows or more, totals."""
    labelled, out = stored(_labelled(spark, sf_dir)), []
    for k in ("t", "i"):
        book = spark.createDataFrame([("A>B", s, n, t) for n, (s, t) in enumerate(BOOKS[k])], "match string, sheet string, pos int, src string")
        columns = labelled.withColumnRenamed("sheet", "src").join(F.broadcast(book), "src").drop("src", "pos")
        size = columns.groupBy("match", "sheet").agg(F.count("*").alias("width"), F.max("n_cells").cast("int").alias("height"))
        region = lambda n, kind, a, b: F.struct(F.lit(n).alias("region"), F.lit(kind).alias("type"), a.alias("first_row"), b.alias("last_row"))
        rows = F.col("height")
        parts = F.array(region(0, "header", F.lit(1), F.lit(1)), region(1, "body", F.lit(2), rows + 1), region(2, "totals", rows + 2, rows + 2))
        regions = size.select("match", "sheet", F.inline(F.filter(parts, lambda r: (r["region"] < 2) | (F.col("height") >= 1000))))
        texts = lambda *x: F.array(*x).cast("array<string>")
        layout = {"merges": texts(F.lit("A1:B1")), "tables": texts(F.col("sheet")), "validations": texts(), "freeze": F.lit("A2"), "filter": F.lit(None).cast("string"), "hidden": F.lit("")}
        sheets = book.join(size, ["match", "sheet"]).select("match", "sheet", "pos", F.create_map(F.lit("direct_sum"), "width").alias("kinds"), *[c.alias(n) for n, c in layout.items()])
        out.append({"sheets": sheets, "columns": columns, "regions": regions})
    return out


@query(f"""WITH RECURSIVE {_REPORT}
SELECT t_sheet, i_sheet, how, region_score, column_score, formula_score, structural_score, CAST(round_even(column_score * 0.40 + region_score * 0.25 + structural_score * 0.20 + formula_score * 0.15, 0) AS INT) AS pair_score FROM rp
UNION ALL SELECT t_sheet, NULL, NULL, 0, 0, 0, 0, 0 FROM sp WHERE i_sheet IS NULL""")
def match_report(spark, sf_dir):
    """Two workbooks made of the given tables: paired sheets with the parts of their score, the one without a counterpart too."""
    return match(*_books(spark, sf_dir)).sheets.select("t_sheet", "i_sheet", "how", "region_score", "column_score", "formula_score", "structural_score", "pair_score")


@query(f"""WITH RECURSIVE {_REPORT}, taken AS (SELECT sp.i_sheet, m.i_col FROM matched m JOIN sp ON sp.t_sheet = m.pair WHERE m.i_col IS NOT NULL)
SELECT sp.i_sheet AS sheet, 'extra column' AS what, h.col AS number FROM sp JOIN hd h ON h.sheet = sp.i WHERE NOT EXISTS (SELECT 1 FROM taken WHERE taken.i_sheet = sp.i_sheet AND taken.i_col = h.col)
UNION ALL SELECT sp.i_sheet, 'extra region', 2 FROM sp JOIN sz a ON a.sheet = t JOIN sz b ON b.sheet = i WHERE a.height < 1000 AND b.height >= 1000
UNION ALL SELECT i.sheet, 'extra sheet', NULL FROM {_BOOK("i")} WHERE i.sheet NOT IN (SELECT i_sheet FROM sp WHERE i_sheet IS NOT NULL)
UNION ALL SELECT pair, 'unmatched column', t_col FROM matched WHERE i_col IS NULL
UNION ALL SELECT t_sheet, 'unmatched region', 2 FROM sp JOIN sz a ON a.sheet = t JOIN sz b ON b.sheet = i WHERE a.height >= 1000 AND b.height < 1000
UNION ALL SELECT pair, 'conflict value_kind', m.t_col FROM matched m JOIN sp ON sp.t_sheet = m.pair JOIN hd a ON a.sheet = sp.t AND a.col = m.t_col JOIN hd b ON b.sheet = sp.i AND b.col = m.i_col WHERE a.type <> b.type""")
def match_leftovers(spark, sf_dir):
    """What the same two workbooks don't share, and where matched columns differ in kind."""
    r = match(*_books(spark, sf_dir))
    part = lambda df, sheet, what, number: df.select(F.col(sheet).alias("sheet"), what.alias("what"), F.col(number).cast("int").alias("number"))
    rows = [part(r.extras, "i_sheet", F.concat(F.lit("extra "), "kind"), "number"), part(r.columns.where("i_col is null"), "t_sheet", F.lit("unmatched column"), "t_col")]
    rows += [part(r.regions.where("i_region is null"), "t_sheet", F.lit("unmatched region"), "t_region"), part(r.conflicts, "t_sheet", F.concat(F.lit("conflict "), "kind"), "t_col")]
    return reduce(lambda a, b: a.unionByName(b), rows)


@query(f"""WITH {_ROLES} SELECT sheet || '.' || col AS subject, role, score, CASE WHEN length(sheet) % 2 = 0 AND col % 2 = 0 THEN 'accepted' WHEN length(sheet) % 2 = 0 AND col % 3 = 0 THEN 'rejected' ELSE 'pending' END AS state FROM roles WHERE requires_review OR level = 'LOW'""")
def review_overlay(spark, sf_dir):
    roles = _roles(spark, sf_dir).withColumn("subject", F.concat_ws(".", "sheet", F.col("col").cast("string")))
    state = F.when((F.length("sheet") % 2 == 0) & (F.col("col") % 2 == 0), "accepted").when((F.length("sheet") % 2 == 0) & (F.col("col") % 3 == 0), "rejected")
    decisions = roles.select("subject", state.alias("state"))
    return M.review_state(roles.where("requires_review or level = 'LOW'").select("subject", "role", "score"), decisions, "subject")


_SRC = f"""{_ROLES}, c AS (SELECT cols.*, role, {_UNITS} AS unit FROM cols JOIN roles USING (sheet, col)),
ss AS (SELECT a.col AS s_col, b.col AS t_col, CAST(least(100, CASE WHEN a.norm = b.norm THEN 55 ELSE 0 END + CASE WHEN a.role = b.role THEN 25 ELSE 0 END + CASE WHEN a.type = b.type THEN 12 ELSE 0 END
   + CASE WHEN a.unit = b.unit THEN 8 ELSE 0 END + CASE WHEN b.non_null = b.n_cells AND b.role = 'identifier' THEN 5 ELSE 0 END) AS INT) AS score FROM c a, c b WHERE a.sheet = 'customer' AND b.sheet = 'orders')"""


def _source_scores(spark, sf_dir):
    c = _labelled(spark, sf_dir, ("customer", "orders")).withColumn("unit", K.unit_guess(F.col("norm"), F.col("type")))
    required = (F.col("non_null") == F.col("n_cells")) & (F.col("role") == "identifier")
    return M.source_scores(c.where("sheet = 'customer'"), c.where("sheet = 'orders'").withColumn("required", required))


@query(f"WITH {_SRC} SELECT * FROM ss")
def mapping_scores(spark, sf_dir):
    return _source_scores(spark, sf_dir)


@query(f"""WITH RECURSIVE {_SRC},
walk AS (SELECT 0 AS k, CAST(NULL AS INT) AS t_col, CAST(NULL AS INT) AS score, CAST([] AS INT[]) AS used
  UNION ALL SELECT w.k + 1, CASE WHEN f.x[1].score >= 30 THEN f.x[1].t_col END, CASE WHEN f.x[1].score >= 30 THEN f.x[1].score END, CASE WHEN f.x[1].score >= 30 THEN list_append(w.used, f.x[1].t_col) ELSE w.used END
  FROM walk w, LATERAL (SELECT list({{'score': ss.score, 't_col': ss.t_col}} ORDER BY ss.score DESC, ss.t_col) AS x FROM ss WHERE ss.s_col = w.k + 1 AND NOT list_contains(w.used, ss.t_col)) f WHERE w.k < 5)
SELECT k AS s_col, t_col, score, CASE WHEN t_col IS NULL THEN 'unresolved' ELSE 'mapped' END AS state FROM walk WHERE k > 0""")
def mapping_plan(spark, sf_dir):
    """Customer columns assigned to order columns, each to its best free one."""
    scores = _source_scores(spark, sf_dir).withColumn("pair", F.lit("plan"))
    got = M.greedy(scores, "pair", "s_col", "t_col")
    return got.select("s_col", "t_col", "score", F.when(F.col("t_col").isNull(), "unresolved").otherwise("mapped").alias("state"))


@query("""
SELECT l_orderkey, l_linenumber, o_orderkey AS merge_start, CASE WHEN l_orderkey = o_orderkey THEN 'top_left' ELSE 'inside' END AS status
FROM lineitem JOIN (SELECT o_orderkey, o_orderkey + o_custkey % 4 AS last FROM orders) m ON l_orderkey BETWEEN m.o_orderkey AND m.last""")
def merge_status(spark, sf_dir):
    """Rows inside merged ranges: an interval join dealt into bins."""
    ranges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("merge_start"), (F.col("o_orderkey") + F.col("o_custkey") % 4).alias("merge_end"))
    out = X.within_ranges(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ranges, "l_orderkey", "merge_start", "merge_end", [])
    return out.select("l_orderkey", "l_linenumber", "merge_start", F.when(F.col("l_orderkey") == F.col("merge_start"), "top_left").otherwise("inside").alias("status"))


@query("SELECT l_orderkey, l_linenumber, p_brand AS lookup_value, CASE WHEN p_partkey IS NULL THEN 'LOOKUP_NOT_FOUND' ELSE 'found' END AS lookup_status FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def lookup_left(spark, sf_dir):
    build = X.last_wins(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey", "p_partkey")
    return X.lookup(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", build, "p_brand").drop("l_partkey")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def lookup_missing(spark, sf_dir):
    """Keys that the lookup table does not have."""
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT c_custkey, o.o_orderkey AS lookup_value FROM (SELECT c_custkey FROM customer) LEFT JOIN (SELECT o_custkey, CAST(max(o_orderkey) AS VARCHAR) AS o_orderkey FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def lookup_last_wins(spark, sf_dir):
    """Of several orders of a customer the last one answers."""
    build = X.last_wins(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")
    return X.lookup(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", build, "o_orderkey", "null").select("c_custkey", "lookup_value")


@query("""
WITH a AS (SELECT o_orderkey, printf('%.2f', o_totalprice) AS v FROM orders), b AS (SELECT o_orderkey + CASE WHEN o_orderkey % 31 = 0 THEN 10000000 ELSE 0 END AS o_orderkey, printf('%.2f', o_totalprice + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END) AS v FROM orders),
d AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.v AS old, b.v AS new, coalesce(a.o_orderkey, b.o_orderkey) % 39 = 0 AS plan, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.v <> b.v THEN 'changed' END AS change FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)
SELECT o_orderkey, old, new, CASE WHEN plan THEN CASE WHEN change IS NULL THEN 'noop' ELSE 'planned' END ELSE 'unexpected' END AS status, change FROM d WHERE change IS NOT NULL OR plan""")
def snapshot_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    before = o.select("o_orderkey", F.format_string("%.2f", "o_totalprice").alias("v"))
    after = o.select((k + F.when(k % 31 == 0, 10000000).otherwise(0)).alias("o_orderkey"), F.format_string("%.2f", F.col("o_totalprice") + F.when(k % 13 == 0, 1).otherwise(0)).alias("v"))
    planned = before.select("o_orderkey").union(after.select("o_orderkey")).distinct().where("o_orderkey % 39 = 0")
    return X.snapshot_diff(before, after, ["o_orderkey"], "v", planned)


@query("""WITH x AS (SELECT o_custkey, sha256(CAST(o_orderkey AS VARCHAR) || '=' || o_orderstatus || '=' || printf('%.2f', o_totalprice)) AS d FROM orders),
s AS (SELECT o_custkey, sum(CAST('0x' || substr(d, 1, 15) AS BIGINT)) AS a, sum(CAST('0x' || substr(d, 16, 15) AS BIGINT)) AS b, count(*) AS n FROM x GROUP BY 1)
SELECT o_custkey, sha256(CAST(a AS VARCHAR) || '|' || CAST(b AS VARCHAR) || '|' || n) AS fingerprint, n FROM s""")
def region_fingerprint(spark, sf_dir):
    return X.fingerprint(table(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.format_string("%.2f", "o_totalprice"))


_LEDGER = "SELECT event_id AS seq, user_id AS plan, CAST(event_id % 40 AS BIGINT) AS region, CASE event_type WHEN 'purchase' THEN 'committed' WHEN 'error' THEN 'failed' ELSE 'staged' END AS status FROM events"


def _ledger(spark, sf_dir):
    status = F.when(F.col("event_type") == "purchase", "committed").when(F.col("event_type") == "error", "failed").otherwise("staged")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("plan"), (F.col("event_id") % 40).alias("region"), status.alias("status"))


@query(f"""
WITH l AS ({_LEDGER}), r AS (SELECT c_custkey AS plan, c_nationkey + 10 AS region, c_custkey % 3 = 0 AS region_empty FROM customer), d AS (SELECT plan, list(DISTINCT region) AS regions, count(*) AS n FROM l WHERE status = 'committed' GROUP BY 1)
SELECT r.plan, r.region, CASE WHEN n IS NULL THEN 'first_run' WHEN list_contains(regions, r.region) THEN 'already_applied' WHEN region_empty THEN 'safe_to_reapply' ELSE 'conflict' END AS decision, coalesce(n, 0) AS n_committed FROM r LEFT JOIN d USING (plan)""")
def idempotency_state(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    requests = c.select(F.col("c_custkey").alias("plan"), (F.col("c_nationkey") + 10).cast("long").alias("region"), (F.col("c_custkey") % 3 == 0).alias("region_empty"))
    return X.idempotency(requests, _ledger(spark, sf_dir))


@query(f"SELECT * FROM ({_LEDGER}) ORDER BY seq DESC LIMIT 200")
def ledger_tail(spark, sf_dir):
    return X.tail(_ledger(spark, sf_dir), "seq")


_BLOCKS = "SELECT CAST(o_custkey % 25 AS BIGINT) AS sheet, o_custkey AS block, min(o_orderkey) AS first_row, min(o_orderkey) + count(*) FILTER (o_orderstatus = 'F') AS last_row, count(*) AS planned FROM orders GROUP BY 1, 2"


def _blocks(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 25).alias("sheet"), F.col("o_custkey").alias("block"))
    return o.agg(F.min("o_orderkey").alias("first_row"), (F.min("o_orderkey") + F.count_if(F.col("o_orderstatus") == "F")).alias("last_row"), F.count("*").alias("planned"))


@query(f"SELECT *, last_row - first_row + 1 AS existing, greatest(0, planned - (last_row - first_row + 1)) AS rows_to_add, last_row + 1 AS insert_at FROM ({_BLOCKS})")
def expansion_plan(spark, sf_dir):
    return X.expansion(_blocks(spark, sf_dir))


@query(f"""WITH e AS (SELECT *, greatest(0, planned - (last_row - first_row + 1)) AS rows_to_add FROM ({_BLOCKS})), s AS (SELECT *, coalesce(sum(rows_to_add) OVER (PARTITION BY sheet ORDER BY first_row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM e)
SELECT sheet, block, CAST(shift AS BIGINT) AS shift, CAST(first_row + shift AS BIGINT) AS new_first, CAST(last_row + shift + rows_to_add AS BIGINT) AS new_last FROM s""")
def locator_shift(spark, sf_dir):
    return X.shifted(_blocks(spark, sf_dir)).select("sheet", "block", "shift", "new_first", "new_last")


@query("""
WITH h AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), u AS (SELECT DISTINCT user_id FROM events), t AS (SELECT DISTINCT event_type FROM events),
g AS (SELECT u.user_id, t.event_type, coalesce(h.n, 0) AS n FROM u, t LEFT JOIN h ON h.user_id = u.user_id AND h.event_type = t.event_type)
SELECT a.user_id, CAST(100 - floor(100 * sum(abs(a.n - b.n)) / sum(a.n + b.n)) AS INT) AS similarity FROM g a JOIN g b ON b.user_id = a.user_id + 1 AND a.event_type = b.event_type GROUP BY 1""")
def histogram_similarity(spark, sf_dir):
    """How alike the kinds of events of users with neighbouring ids are."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").count()
    hist = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "count"))).alias("h"))
    other = hist.select((F.col("user_id") - 1).alias("user_id"), F.col("h").alias("other"))
    return hist.join(other, "user_id").select("user_id", M.histogram_similarity(F.col("h"), F.col("other")).alias("similarity"))


@query("""
SELECT p.event_id, p.user_id, p.ts, e.event_id AS found_id, e.ts AS ts_found FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY 1, 2) e ON e.user_id = p.user_id AND e.ts <= p.ts""")
def nearest_before(spark, sf_dir):
    """Each purchase with its user's latest sign-up before it: an as-of join in one ordered pass."""
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("found_id"))
    return X.as_of(left, right, ["user_id"], "ts", [F.col("found_id")], ["found_id"])
