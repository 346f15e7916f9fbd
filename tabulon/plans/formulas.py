"""Queries over formulas: a grid of them is written from the orders, one shape of range for each sheet, every 17th row deviating."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.formulas import copy_down as copy_formula
from ..functions.formulas import formula_kind as kind_of
from ..functions.formulas import intent as intent_of
from ..functions.formulas import intent_confidence, ref_profile
from ..functions.refs import index_to_col
from ..operators import formulas as O
from ..operators import synthesis as Y
from ..operators.cycles import cycle_groups
from ..sources.rounds import stored
from .registry import query, table

#: Column J by sheet number modulo 11 (10: a sheet with formulas along row 5): text with {r} and {n} = r + 1, {m} = r + 2; signature; window.
SHAPES = [
    ("=SUM($F$1:F{r})", "SUM(R1C6:R[0]C[-4])", "expanding"),
    ("=SUM($F$1:F{r})", "SUM(R1C6:R[0]C[-4])", "expanding"),
    ("=SUM(F{r}:F{m})", "SUM(R[0]C[-4]:R[2]C[-4])", "rolling"),
    ("=SUM(A{r}:C{r})", "SUM(R[0]C[-9]:R[0]C[-7])", "single_row"),
    ("=SUM($F$1:$F$9)", "SUM(R1C6:R9C6)", "fixed"),
    ("=SUM(F:F)", "SUM(#COL[-4])", "whole_column"),
    ("=SUM(Data!$B$2:$B$10)", "SUM(DATA!R2C2:R10C2)", "cross_sheet_fixed"),
    ("=SUM(Data!B{r}:B{n})", "SUM(DATA!R[0]C[-8]:R[1]C[-8])", "cross_sheet_relative"),
    ("=SUM(F{r}:F$600)", "SUM(R[0]C[-4]:R600C[-4])", "UNKNOWN_WINDOW"),
    ("=SUM($F$1:F{r})*G{r}", "SUM(R1C6:R[0]C[-4])*R[0]C[-3]", "expanding"),
]


def _place(key):
    """Row, or column, of an order in its sheet: a free one after every 25th, five after every 60th."""
    m = F.pmod(key, F.lit(500))
    return (m + 1 + F.floor(m / 25) + 4 * F.floor(m / 60)).cast("int")


_PLACE = "CAST(o_orderkey % 500 + 1 + (o_orderkey % 500) // 25 + 4 * ((o_orderkey % 500) // 60) AS INT)"


def _grid(spark, sf_dir):
    """Column H: =F*G, or =F/G where the row is divisible by 17; column J: a range on odd hundreds; or formulas along a row."""
    o = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 500).alias("no"), _place(F.col("o_orderkey")).alias("at"))
    o = o.select(F.concat(F.lit("S"), F.col("no").cast("string")).alias("sheet"), (F.col("no") % 11).alias("shape"), "at", F.col("at").cast("string").alias("r"))
    h = F.concat(F.lit("=F"), "r", F.when(F.col("at") % 17 == 0, "/G").otherwise("*G"), "r")
    j = F.lit(None).cast("string")
    for i, (text, _, _) in enumerate(SHAPES):
        made = F.lit(text)
        for mark, n in (("{r}", 0), ("{n}", 1), ("{m}", 2)):
            made = F.replace(made, F.lit(mark), (F.col("at") + n).cast("string"))
        j = F.when(F.col("shape") == i, made).otherwise(j)
    letter = index_to_col(F.col("at"))
    along = F.struct(F.lit(5).alias("row"), F.col("at").alias("col"), F.concat(F.lit("="), letter, F.lit("3*"), letter, F.lit("4")).alias("text"))
    down = lambda c, text: F.struct(F.col("at").alias("row"), F.lit(c).alias("col"), text.alias("text"))
    odd = F.floor(F.col("at") / 100) % 2 == 1
    cells = F.when(F.col("shape") == 10, F.array(along)).when(odd, F.array(down(8, h), down(10, j))).otherwise(F.array(down(8, h)))
    return o.select("sheet", F.inline(cells))


def _case(i: int, quote=lambda x: x) -> str:
    return "CASE shape " + " ".join(f"WHEN {k} THEN {quote(s[i])}" for k, s in enumerate(SHAPES)) + " END"


def _text(at: str) -> str:
    return _case(0, lambda t: "'" + t.replace("{r}", f"' || {at} || '").replace("{n}", f"' || ({at} + 1) || '").replace("{m}", f"' || ({at} + 2) || '") + "'")


_LETTER = "(CASE WHEN pos > 26 THEN chr(64 + (pos - 1) // 26) ELSE '' END || chr(65 + (pos - 1) % 26))"
_O = f"o AS (SELECT 'S' || CAST(o_orderkey // 500 AS VARCHAR) AS sheet, (o_orderkey // 500) % 11 AS shape, {_PLACE} AS pos FROM orders)"
_G = f"""{_O}, g AS (SELECT sheet, shape, 'vertical' AS orientation, 8 AS line, pos, pos AS row, 8 AS col, '=F' || pos || CASE WHEN pos % 17 = 0 THEN '/G' ELSE '*G' END || pos AS text,
    CASE WHEN pos % 17 = 0 THEN 'R[0]C[-2]/R[0]C[-1]' ELSE 'R[0]C[-2]*R[0]C[-1]' END AS signature, 'single_cell' AS win FROM o WHERE shape < 10
  UNION ALL SELECT sheet, shape, 'vertical', 10, pos, pos, 10, {_text("pos")}, {_case(1, repr)}, {_case(2, repr)} FROM o WHERE shape < 10 AND (pos // 100) % 2 = 1
  UNION ALL SELECT sheet, shape, 'horizontal', 5, pos, 5, pos, '=' || {_LETTER} || '3*' || {_LETTER} || '4', 'R[-2]C[0]*R[-1]C[0]', 'single_cell' FROM o WHERE shape = 10)"""


def _cells(spark, sf_dir):
    """The grid's formulas with their parse: read once and stored, whatever is derived from them."""
    return stored(O.parsed(_grid(spark, sf_dir)))


@query(f"WITH {_G} SELECT sheet, row, col, signature FROM g")
def formula_signatures(spark, sf_dir):
    return _cells(spark, sf_dir).select("sheet", "row", "col", F.col("p.signature").alias("signature"))


@query(f"""WITH {_G}, n AS (SELECT sheet, line, shape, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY 1, 2, 3)
SELECT sheet, CAST(sum(n * CASE WHEN line <> 10 OR shape = 9 THEN 2 WHEN shape = 5 THEN 0 ELSE 1 END) AS BIGINT) AS refs_total, CAST(sum(n * CASE WHEN line = 10 AND shape IN (0, 1, 4, 6, 9) THEN 1 ELSE 0 END) AS BIGINT) AS absolute,
  CAST(sum(n * CASE WHEN line = 10 AND shape IN (6, 7) THEN 1 ELSE 0 END) AS BIGINT) AS cross_sheet, CAST(sum(n * CASE WHEN line = 10 AND shape = 3 THEN 1 ELSE 0 END) AS BIGINT) AS horizontal FROM n GROUP BY 1""")
def reference_profiles(spark, sf_dir):
    """How the references of each sheet's formulas are anchored and shaped."""
    r = _cells(spark, sf_dir).select("sheet", ref_profile(F.col("p")).alias("r"))
    return r.groupBy("sheet").agg(*[F.sum(f"r.{c}").alias(c) for c in ("refs_total", "absolute", "cross_sheet", "horizontal")])


_INTENT = "CASE WHEN orientation = 'horizontal' OR line = 8 AND row % 17 <> 0 THEN 'calculation' WHEN line = 8 THEN 'ratio' ELSE 'aggregation' END"


@query(f"""WITH {_G} SELECT sheet, CASE WHEN line = 10 THEN 'function' ELSE 'relative_arithmetic' END AS kind, {_INTENT} AS intent,
  CASE WHEN line = 8 AND row % 17 = 0 OR line = 10 AND shape = 9 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence, count(*) AS n FROM g GROUP BY ALL""")
def formula_intent(spark, sf_dir):
    c = _cells(spark, sf_dir).withColumn("intent", intent_of(F.col("p")))
    return c.groupBy("sheet", kind_of(F.col("p")).alias("kind"), "intent", intent_confidence(F.col("p"), F.col("intent")).alias("confidence")).agg(F.count("*").alias("n"))


_FAMILIES = f"""{_G}, s AS (SELECT *, pos - lag(pos) OVER (PARTITION BY sheet, orientation, line ORDER BY pos) AS gap FROM g),
r AS (SELECT *, CAST(sum(CASE WHEN gap > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY sheet, orientation, line ORDER BY pos) AS BIGINT) AS run FROM s),
d AS (SELECT sheet, orientation, line, run, signature, count(*) AS n, row_number() OVER (PARTITION BY sheet, orientation, line, run ORDER BY count(*) DESC, signature) AS k FROM r GROUP BY 1, 2, 3, 4, 5),
a AS (SELECT r.*, d.signature AS family, r.signature = d.signature AS member FROM r JOIN d ON d.sheet = r.sheet AND d.orientation = r.orientation AND d.line = r.line AND d.run = r.run AND d.k = 1 AND d.n >= 2),
m AS (SELECT *, pos - lag(pos) OVER (PARTITION BY sheet, orientation, line, run ORDER BY pos) AS step FROM a WHERE member),
f AS (SELECT sheet, orientation, line, run, any_value(family) AS signature, any_value(win) AS win, any_value({_INTENT}) AS intent, count(*) AS members, min(pos) AS start, max(pos) AS "end", count(*) FILTER (step > 1) AS gaps, coalesce(min(step) = max(step), false) AS regular FROM m GROUP BY 1, 2, 3, 4),
x AS (SELECT sheet, orientation, line, run, count(*) FILTER (NOT member) AS outliers, count(*) FILTER (gap BETWEEN 2 AND 3) AS run_gaps FROM a GROUP BY 1, 2, 3, 4),
fam AS (SELECT f.*, outliers, run_gaps, CASE WHEN members >= 3 AND regular THEN win ELSE 'UNKNOWN_WINDOW' END AS window_type,
  CASE WHEN members >= 3 AND gaps = 0 AND run_gaps = 0 THEN 'HIGH' WHEN members = 2 AND gaps = 0 AND run_gaps = 0 OR members >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM f JOIN x USING (sheet, orientation, line, run))"""


def _families(spark, sf_dir):
    return O.families(O.family_cells(_cells(spark, sf_dir)))


@query(f"WITH {_FAMILIES} SELECT sheet, orientation, line, signature, members, start, \"end\", gaps, run_gaps, outliers, confidence, intent FROM fam")
def formula_families(spark, sf_dir):
    found, _ = _families(spark, sf_dir)
    return found.select("sheet", "orientation", "line", "signature", "members", "start", "end", "gaps", "run_gaps", "outliers", "confidence", "intent")


@query(f"WITH {_FAMILIES} SELECT sheet, row, col, text, family FROM a WHERE NOT member")
def formula_outliers(spark, sf_dir):
    _, cells = _families(spark, sf_dir)
    return cells.where("state = 'outlier'").select("sheet", "row", "col", "text", "family")


@query(f"WITH {_FAMILIES} SELECT sheet, orientation, line, start, window_type FROM fam")
def formula_windows(spark, sf_dir):
    return _families(spark, sf_dir)[0].select("sheet", "orientation", "line", "start", F.col("window").alias("window_type"))


@query("""WITH l AS (SELECT l_orderkey // 500 AS no, CAST(l_orderkey % 500 + 1 AS INT) AS row, max(l_linenumber) AS k FROM lineitem GROUP BY 1, 2),
s AS (SELECT CAST(no AS VARCHAR) AS sheet, row, greatest(1, row - k) AS low FROM l)
SELECT s.sheet || '!R' || s.row || 'C5' AS source, s.sheet || '!R' || t.row || 'C4' AS target, 'range' AS kind FROM s JOIN s t ON t.sheet = s.sheet AND t.row BETWEEN s.low AND s.row
UNION SELECT sheet || '!R' || row || 'C5', sheet || '!D' || low || ':D' || row, 'range_node' FROM s
UNION SELECT sheet || '!R' || row || 'C4', sheet || '!R' || row || 'C3', 'point' FROM s""")
def dependency_edges(spark, sf_dir):
    """Edges of a grid with a row for each order: column E sums a stretch of column D, and D reads C."""
    l = table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 500).cast("string").alias("sheet"), (F.col("l_orderkey") % 500 + 1).cast("int").alias("row")).agg(F.max("l_linenumber").alias("k"))
    r, low = F.col("row").cast("string"), F.greatest(F.lit(1), F.col("row") - F.col("k")).cast("string")
    d = F.struct(F.lit(4).alias("col"), F.concat(F.lit("=C"), r).alias("text"))
    e = F.struct(F.lit(5).alias("col"), F.concat(F.lit("=SUM(D"), low, F.lit(":D"), r, F.lit(")")).alias("text"))
    return O.edges(stored(O.parsed(l.select("sheet", "row", F.inline(F.array(d, e))))))


_RING = """o AS (SELECT 'C' || o_custkey AS sheet, o_orderpriority = '1-URGENT' AS back, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
e AS (SELECT sheet, i, CASE WHEN i < n THEN i + 1 ELSE 1 END AS j FROM o WHERE i < n OR n % 2 = 1 UNION SELECT sheet, i, i - 3 FROM o WHERE back AND i > 3)"""


@query(f"""WITH RECURSIVE {_RING}, r AS (SELECT sheet, i, j FROM e UNION SELECT r.sheet, r.i, e.j FROM r JOIN e ON e.sheet = r.sheet AND e.i = r.j)
SELECT a.sheet || '!R' || a.i || 'C1' AS node, min(a.sheet || '!R' || a.j || 'C1') AS component, count(*) AS size FROM r a JOIN r b ON b.sheet = a.sheet AND b.i = a.j AND b.j = a.i GROUP BY a.sheet, a.i""")
def dependency_cycles(spark, sf_dir):
    """Cells on cycles: a sheet for each customer, whose orders read the next one, the last of an odd number the first; urgent ones also the third before."""
    own = Window.partitionBy("o_custkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderpriority") == "1-URGENT").alias("back"), F.row_number().over(own.orderBy("o_orderkey")).alias("row"), F.count("*").over(own).alias("n"))
    read = lambda n: F.concat(F.lit("A"), n.cast("string"))
    row = F.col("row")
    ahead = F.when(row < F.col("n"), read(row + 1)).when(F.col("n") % 2 == 1, "A1").otherwise("B1")
    text = F.concat(F.lit("="), ahead, F.when(F.col("back") & (row > 3), F.concat(F.lit("+"), read(row - 3))).otherwise(""))
    cells = o.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("sheet"), "row", F.lit(1).alias("col"), text.alias("text"))
    return cycle_groups(O.edges(stored(O.parsed(cells))))


@query("SELECT l_orderkey, l_linenumber, '=F' || (l_linenumber + 5) || '*$G$2+SUM(A' || (l_linenumber + 5) || ':A$9)&\"A1\"' AS moved FROM lineitem")
def copy_down(spark, sf_dir):
    """A formula copied down five rows."""
    n = F.col("l_linenumber").cast("string")
    text = F.concat(F.lit("=F"), n, F.lit("*$G$2+SUM(A"), n, F.lit(':A$9)&"A1"'))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", copy_formula(text, F.lit(5)).alias("moved"))


@query(f"""WITH {_FAMILIES}, t AS (SELECT DISTINCT sheet, shape, 601 AS row, c AS col FROM o, (VALUES (8), (10), (12)) v(c)),
n AS (SELECT t.*, f."end" AS family_end, f.start AS source_row, f.members, f.confidence, f.window_type, row_number() OVER (PARTITION BY t.sheet, t.col ORDER BY t.row - f."end", f.members DESC, f.signature) AS k
  FROM t LEFT JOIN fam f ON f.sheet = t.sheet AND f.line = t.col AND f."end" < t.row AND f.orientation = 'vertical' AND f.confidence = 'HIGH')
SELECT sheet, row, col, source_row, CASE WHEN family_end IS NULL THEN 'NO_SOURCE_FAMILY' WHEN window_type = 'UNKNOWN_WINDOW' THEN 'WINDOW_PATTERN_NOT_DETERMINISTIC' END AS blocked,
 CASE WHEN family_end IS NOT NULL AND window_type <> 'UNKNOWN_WINDOW' THEN CASE col WHEN 8 THEN '=F601*G601' ELSE {_text("601")} END END AS formula FROM n WHERE k = 1""")
def synthesis_gate(spark, sf_dir):
    """A formula for row 601 of each sheet from the nearest family above that may be copied, or what stands against it."""
    cells = _cells(spark, sf_dir)
    targets = cells.select("sheet").distinct().select("sheet", F.lit(601).alias("row"), F.explode(F.array(F.lit(8), F.lit(10), F.lit(12))).alias("col"), F.lit(None).cast("string").alias("family_id"), F.lit(False).alias("has_formula"))
    return Y.plan(targets, Y.with_ids(O.families(O.family_cells(cells))[0]), cells).select("sheet", "row", "col", "source_row", "blocked", "formula")


_PLAN = f"""{_FAMILIES}, y AS (SELECT *, sheet || '!' || orientation || ':' || line || ':' || start AS family_id FROM fam),
t AS (SELECT sheet, CASE orientation WHEN 'vertical' THEN "end" + 1 ELSE 6 END AS row, CASE orientation WHEN 'vertical' THEN line ELSE start END AS col, family_id, orientation, confidence, win, window_type, signature, start, line FROM y),
p AS (SELECT t.*, (SELECT any_value(shape) FROM o WHERE o.sheet = t.sheet) AS shape, CASE WHEN t.orientation <> 'vertical' THEN 'TARGET_COLUMN_MISMATCH' WHEN confidence <> 'HIGH' THEN 'FAMILY_CONFIDENCE_BELOW_HIGH' WHEN window_type = 'UNKNOWN_WINDOW' THEN 'WINDOW_PATTERN_NOT_DETERMINISTIC'
  WHEN t.row % 7 = 0 THEN 'TARGET_NOT_ALLOWED' WHEN t.row % 5 = 0 THEN 'TARGET_STATE_UNKNOWN' WHEN g.sheet IS NOT NULL THEN 'TARGET_ALREADY_FORMULA' END AS blocked FROM t LEFT JOIN g ON g.sheet = t.sheet AND g.row = t.row AND g.col = t.col),
plan AS (SELECT sheet, row, col, family_id, signature, CASE WHEN orientation = 'vertical' THEN start END AS source_row, CASE WHEN orientation = 'vertical' THEN row - start END AS moved, blocked, CASE WHEN blocked IS NULL THEN CASE col WHEN 8 THEN '=F' || row || '*G' || row ELSE {_text("row")} END END AS formula FROM p)"""


def _plan(spark, sf_dir):
    """The cell behind the end of each family, named; rows divisible by 7 may not be written, of those divisible by 5 nothing is known."""
    cells = _cells(spark, sf_dir)
    found = stored(Y.with_ids(O.families(O.family_cells(cells))[0]))
    down = F.col("orientation") == "vertical"
    targets = found.select("sheet", F.when(down, F.col("end") + 1).otherwise(6).alias("row"), F.when(down, F.col("line")).otherwise(F.col("start")).alias("col"), "family_id")
    states = O.target_states(targets.select("sheet", "row", "col"), cells.withColumn("kind", F.lit("formula"))).select("sheet", "row", "col", F.when(F.col("row") % 5 != 0, F.col("has_formula")).alias("has_formula"))
    return Y.plan(targets.join(states, ["sheet", "row", "col"]), found, cells, targets.where("row % 7 <> 0")), cells


@query(f"WITH {_PLAN} SELECT sheet, row, col, family_id, CASE WHEN moved IS NOT NULL THEN source_row END AS source_row, moved, blocked, formula FROM plan")
def synthesis_plan(spark, sf_dir):
    """A formula behind the end of each family, or the gate that stops it."""
    out = _plan(spark, sf_dir)[0]
    return out.select("sheet", "row", "col", "family_id", F.when(F.col("moved").isNotNull(), F.col("source_row")).alias("source_row"), "moved", "blocked", "formula")


@query(f"""WITH {_PLAN}, n AS (SELECT sheet, count(*) FILTER (blocked IS NULL) AS n, count(*) FILTER (blocked IS NULL AND row % 3 <> 0) AS there, count(*) FILTER (blocked IS NULL AND row % 3 = 1) AS same FROM plan GROUP BY 1),
u AS (SELECT sheet, count(*) AS changed, count(*) FILTER (row % 2 = 0) AS gone FROM g WHERE (row + col) % 97 = 0 GROUP BY 1),
k AS (SELECT sheet, coalesce(n, 0) AS n, coalesce(there, 0) AS there, coalesce(same, 0) AS same, coalesce(changed, 0) AS changed, coalesce(gone, 0) AS gone, n IS NOT NULL AS planned FROM n FULL JOIN u USING (sheet)),
v AS (SELECT sheet, planned, changed, unnest([['formula_count_delta', n::VARCHAR, (there - gone)::VARCHAR], ['formula_exists', n::VARCHAR, there::VARCHAR], ['syntax_preserved', n::VARCHAR, same::VARCHAR], ['signature_matched', n::VARCHAR, same::VARCHAR], ['offsets_matched', n::VARCHAR, there::VARCHAR],
  ['absolute_preserved', n::VARCHAR, there::VARCHAR], ['sheets_preserved', n::VARCHAR, there::VARCHAR], ['unrelated_changed', '0', changed::VARCHAR]]) AS x FROM k)
SELECT sheet, x[1] AS "check", x[2]::BIGINT AS expected, x[3]::BIGINT AS found, x[2] = x[3] AS passed FROM v""")
def synthesis_checks(spark, sf_dir):
    """The plan carried out badly: every third formula is missing, every third has a number added, and some others are changed or gone."""
    done, cells = _plan(spark, sf_dir)
    done = stored(done)
    before = cells.select("sheet", "row", "col", "text")
    hit = (F.col("row") + F.col("col")) % 97 == 0
    kept = before.where(~hit | (F.col("row") % 2 == 1)).withColumn("text", F.when(hit, F.concat("text", F.lit("+1"))).otherwise(F.col("text")))
    new = done.where("blocked is null and row % 3 <> 0").select("sheet", "row", "col", F.when(F.col("row") % 3 == 1, F.col("formula")).otherwise(F.concat("formula", F.lit("+1"))).alias("text"))
    return Y.verified(done, before, kept.unionByName(new))


_ODD = ["'=SUM(A1:A9)'", "'=[Book.xlsx]Data!A1'", "'=SUM(Sales[Net])'", "'={{1,2}}'", "'=_xlfn.SORT(A1:A9)'", "'=#REF!+A1'", "'=UNIQUE(A1:A9)+XLOOKUP(A1,B:B,C:C)'", "'=INDIRECT(\"[x]\")'", "'=-A1'", "'text [x]'", "'=A1&\"{{#REF!}}\"'"]
_WHY = [
    [], ["external workbook reference", "structured or external reference", "structured reference"], ["external workbook reference", "structured or external reference", "structured reference"], ["array or constant formula"],
    ["future function (_xlfn)"], ["broken reference (#REF!)"], ["dynamic array function: UNIQUE,XLOOKUP"], ["late-bound function: INDIRECT"], ["formula without a leading reference is not a supported copy-down pattern"],
    ["external workbook reference", "structured reference"], [],
]


@query("WITH r AS (SELECT o_custkey, unnest(CASE o_orderkey % 11 " + " ".join(f"WHEN {k} THEN {w!r}::VARCHAR[]" for k, w in enumerate(_WHY)) + " END) AS reason FROM orders) SELECT o_custkey, reason, count(*) AS n FROM r GROUP BY 1, 2")
def unsupported_formulas(spark, sf_dir):
    """Why formulas of each customer are not copied: one of eleven shapes for each order."""
    shapes = F.element_at(F.array(*[F.expr(t.replace("{{", "{").replace("}}", "}")) for t in _ODD]), (F.col("o_orderkey") % 11 + 1).cast("int"))
    cells = O.parsed(table(spark, sf_dir, "orders").select("o_custkey", F.lit("S").alias("sheet"), F.lit(20).alias("row"), F.lit(9).alias("col"), shapes.alias("text")))
    return cells.select("o_custkey", F.explode(Y.unsupported_reasons(F.col("text"), F.col("p.functions"))).alias("reason")).groupBy("o_custkey", "reason").agg(F.count("*").alias("n"))


@query(f"""WITH {_FAMILIES}, c AS (SELECT g.*, a.member FROM g LEFT JOIN a USING (sheet, orientation, line, pos))
SELECT 'confidence' AS metric, confidence AS key, count(*) AS n FROM fam GROUP BY 1, 2
UNION ALL SELECT 'window', window_type, count(*) FROM fam GROUP BY 1, 2
UNION ALL SELECT 'intent', intent, count(*) FROM fam GROUP BY 1, 2
UNION ALL SELECT 'state', CASE WHEN member THEN 'member' WHEN NOT member THEN 'outlier' ELSE 'single' END, count(*) FROM c GROUP BY 1, 2""")
def engine_report(spark, sf_dir):
    """Counts of families and cells by what was found of them."""
    return O.engine_report(*_families(spark, sf_dir))


@query(f"""WITH {_G}, t AS (SELECT DISTINCT o.sheet, o.pos AS row, c AS col FROM o, (VALUES (8), (10), (11)) v(c))
SELECT t.sheet, t.row, t.col, g.sheet IS NOT NULL AS has_formula, g.sheet IS NOT NULL AS has_value FROM t LEFT JOIN g ON g.sheet = t.sheet AND g.row = t.row AND g.col = t.col""")
def target_states(spark, sf_dir):
    """Whether cells of three columns hold a formula or a value."""
    key = F.col("o_orderkey")
    at = table(spark, sf_dir, "orders").select(F.concat(F.lit("S"), F.floor(key / 500).cast("string")).alias("sheet"), _place(key).alias("row"), F.explode(F.array(F.lit(8), F.lit(10), F.lit(11))).alias("col"))
    return O.target_states(at.distinct(), _grid(spark, sf_dir).withColumn("kind", F.lit("formula")))


@query(f"WITH {_G}, f AS (SELECT sheet, CASE WHEN line = 10 THEN 'SUM' END AS fn FROM g) SELECT fn AS function, count(*) AS n, count(DISTINCT sheet) AS n_sheets FROM f WHERE fn IS NOT NULL GROUP BY 1")
def top_functions(spark, sf_dir):
    c = _cells(spark, sf_dir).select("sheet", F.explode("p.functions").alias("function"))
    return c.groupBy("function").agg(F.count("*").alias("n"), F.countDistinct("sheet").alias("n_sheets"))
