"""Queries over sheets that change: shifted references and ranges, new rows, a dry run over cells, validations and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import truncate_text
from ..operators import filling as L
from ..operators import insertions as I
from ..operators import restructure as R
from .formulas import _FAMILIES, _G, _LETTER, SHAPES, _grid, _text
from .registry import query, table

# ------------------------------------------------------------------- references and ranges

_S = lambda x: f"CASE WHEN {x} >= 100 THEN {x} + 3 ELSE {x} END"


def _shifted_text() -> str:
    """The text of each shape after three rows are inserted at row 100 of its own sheet; references to Data stay."""
    out = []
    for k, (text, _, _) in enumerate(SHAPES):
        t = text.replace("F$600", "F$603")
        own = "Data!" not in t
        for mark, n in (("{r}", 0), ("{n}", 1), ("{m}", 2)):
            value = f"(pos + {n})"
            t = t.replace(mark, f"' || ({_S(value) if own else value}) || '")
        out.append(f"WHEN {k} THEN '{t}'")
    return "CASE shape " + " ".join(out) + " END"


@query(f"""WITH {_G} SELECT sheet, {_S("row")} AS row, col, CASE WHEN line = 8 THEN '=F' || ({_S("pos")}) || CASE WHEN pos % 17 = 0 THEN '/G' ELSE '*G' END || ({_S("pos")})
  WHEN line = 10 THEN {_shifted_text()} ELSE text END AS text FROM g""")
def shifted_references(spark, sf_dir):
    """Every sheet's formulas after three rows are inserted at its row 100."""
    args = (F.lit(100), F.lit(3), F.lit(False))
    text = R.rewrite_references(F.col("text"), F.col("sheet"), F.col("sheet"), "rows", *args)
    return _grid(spark, sf_dir).select("sheet", R.shift_point(F.col("row"), *args).alias("row"), "col", text.alias("text"))


_R = "SELECT o_orderkey, CAST(o_orderkey % 90 + 1 AS INT) AS a, CAST(o_orderkey % 90 + 1 + o_custkey % 7 AS INT) AS b FROM orders"


@query(f"""WITH r AS ({_R}), s AS (SELECT o_orderkey, a, b, CASE WHEN a < 50 THEN a WHEN a >= 60 THEN a - 10 ELSE 50 END AS x, CASE WHEN b < 50 THEN b WHEN b >= 60 THEN b - 10 ELSE 49 END AS y FROM r)
SELECT o_orderkey, 'A' || a || ':C' || b AS was, CASE WHEN x <= y THEN 'A' || x || ':C' || y END AS ref FROM s""")
def shifted_ranges(spark, sf_dir):
    """Ranges after rows 50 to 59 are deleted: clamped, or gone."""
    a = (F.col("o_orderkey") % 90 + 1).cast("int")
    o = table(spark, sf_dir, "orders").select("o_orderkey", a.alias("a"), (a + F.col("o_custkey") % 7).cast("int").alias("b"))
    was = F.concat(F.lit("A"), F.col("a").cast("string"), F.lit(":C"), F.col("b").cast("string"))
    return o.select("o_orderkey", was.alias("was")).withColumn("ref", R.shift_range(F.col("was"), "rows", F.lit(50), F.lit(10), F.lit(True)))


@query(f"""WITH {_FAMILIES}, b AS (SELECT sheet, max(row) AS template_row FROM g WHERE orientation = 'vertical' GROUP BY 1)
SELECT g.sheet, CAST(g.row + k AS INT) AS row, g.col, CASE WHEN line = 8 THEN '=F' || (pos + k) || CASE WHEN pos % 17 = 0 THEN '/G' ELSE '*G' END || (pos + k) ELSE {_text("(pos + k)")} END AS text
FROM g JOIN b ON b.sheet = g.sheet AND b.template_row = g.row CROSS JOIN (VALUES (1), (2)) v(k) WHERE orientation = 'vertical'""")
def new_rows(spark, sf_dir):
    """Two rows added below each sheet's last one, with its formulas copied down."""
    grid = _grid(spark, sf_dir).where("col in (8, 10)")
    last = F.max("row")
    blocks = grid.groupBy("sheet").agg(last.alias("template_row"), (last + 1).alias("insert_at")).select("*", F.lit(2).alias("rows_to_add"), F.lit(8).alias("c0"), F.lit(10).alias("c1"))
    # sheets with formulas along a row have no block
    blocks = blocks.where("template_row > 5")
    return R.provision_rows(grid, blocks)


#: One to three blocks for each part's sheet, after rows 5, 10 and 15.
_B = """b AS (SELECT p_partkey AS k, CAST(5 * j AS INT) AS t, CAST(5 * j + 1 AS INT) AS ins, CAST(j + p_partkey % 3 AS INT) AS n, CAST(coalesce(sum(j + p_partkey % 3) OVER (PARTITION BY p_partkey ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS up
  FROM part, (VALUES (1), (2), (3)) v(j) WHERE j <= p_size % 3 + 1)"""


@query(f"""WITH {_B}, p AS (SELECT p_partkey, p_partkey AS k, p_size, p_size % 4 AS m FROM part),
r AS (SELECT p_partkey, k, 0 AS i, 'A' AS a, CASE WHEN m = 3 THEN 'A' WHEN m = 2 THEN 'B' ELSE 'C' END AS z, 1 AS lo, CASE WHEN m = 1 THEN p_size + 1 WHEN m = 3 THEN 9 ELSE p_size END AS hi, m <> 2 AS rule, m <> 1 AS safe FROM p
  UNION ALL SELECT p_partkey, k, 1, 'D', 'E', 2, 10, true, true FROM p WHERE m = 0),
f AS (SELECT r.*, lo + coalesce((SELECT sum(n) FROM b WHERE b.k = r.k AND ins <= lo), 0) AS lo2, hi + coalesce((SELECT sum(n) FROM b WHERE b.k = r.k AND ins <= hi), 0) AS hi2,
  (SELECT max(ins + up + n - 1) FROM b WHERE b.k = r.k AND t = hi AND safe AND (NOT rule OR a = 'A')) AS last FROM r)
SELECT p_partkey, string_agg(a || lo || ':' || z || hi, ' ' ORDER BY i) AS ref, string_agg(a || CAST(lo2 AS INT) || ':' || z || CAST(coalesce(last, hi2) AS INT), ' ' ORDER BY i) AS "to",
  CASE WHEN bool_and(safe) THEN NULL ELSE 'UNSUPPORTED_VALIDATION_PROPAGATION' END AS warning FROM f GROUP BY p_partkey""")
def stretched_ranges(spark, sf_dir):
    """Validations and tables of each part's sheet when one to three blocks of it grow."""
    size, k = F.col("p_size").cast("string"), F.col("p_size") % 4
    end = F.when(k == 1, (F.col("p_size") + 1).cast("string")).when(k == 3, "9").otherwise(size)
    ref = F.concat(F.lit("A1:"), F.when(k == 3, "A").when(k == 2, "B").otherwise("C"), end, F.when(k == 0, F.lit(" D2:E10")).otherwise(""))
    kind, rule = F.when(k == 2, "table").otherwise("validation"), F.when(k == 1, "none").otherwise("list")
    part = table(spark, sf_dir, "part")
    ranges = part.select("p_partkey", F.col("p_partkey").cast("string").alias("sheet"), kind.alias("kind"), F.lit("x").alias("name"), ref.alias("ref"), rule.alias("type"))
    block = F.explode(F.sequence(F.lit(1), (F.col("p_size") % 3 + 1).cast("int")))
    blocks = part.select(F.col("p_partkey").cast("string").alias("sheet"), (F.col("p_partkey") % 3).cast("int").alias("more"), block.alias("block"))
    blocks = blocks.select("sheet", "block", (F.col("block") * 5).alias("template_row"), (F.col("block") * 5 + 1).alias("insert_at"), (F.col("block") + F.col("more")).alias("rows_to_add"), F.lit(1).alias("c0"), F.lit(3).alias("c1"))
    return I.grown_ranges(ranges, blocks).select("p_partkey", "ref", "to", "warning")


#: Blocks of the grid's sheets: after rows 50, 200 and 400, as many as the sheet's shape modulo 3 and one more; 2, 3 and 4 rows.
_AFTER = [(50, 2), (200, 3), (400, 4)]
_BLOCKS = "k AS (SELECT DISTINCT sheet, shape, t, n, j FROM o, (VALUES " + ", ".join(f"({j}, {t}, {n})" for j, (t, n) in enumerate(_AFTER)) + ") v(j, t, n) WHERE shape < 10 AND j <= shape % 3)"
_F = lambda x: f"({x}" + "".join(f" + CASE WHEN shape % 3 >= {j} AND {x} > {t} THEN {n} ELSE 0 END" for j, (t, n) in enumerate(_AFTER)) + ")"


def _grown_text(at, fixed: str) -> str:
    """The text of column J, with ``at`` of a distance for references of the own sheet that move, ``fixed`` for row 600."""
    out = []
    for i, (text, _, _) in enumerate(SHAPES):
        own = "Data!" not in text
        t = text.replace("F$600", f"F$' || {fixed} || '")
        for mark, d in (("{r}", 0), ("{n}", 1), ("{m}", 2)):
            t = t.replace(mark, f"' || {at(d) if own else at(d, False)} || '")
        out.append(f"WHEN {i} THEN '{t}'")
    return "CASE shape " + " ".join(out) + " END"


_UP = "(" + " + ".join(f"CASE WHEN j > {j} THEN {n} ELSE 0 END" for j, (_, n) in enumerate(_AFTER)) + ")"
_MOVED = lambda d, own=True: _F(f"(pos + {d})") if own else f"(pos + {d})"
# the row that a copied reference ends at: below the template row first past the block's own new rows, then down with the copy, then past the blocks above
_COPIED = lambda d, own=True: f"(pos + {d} + CASE WHEN {d} > 0 THEN n{_LOWER.format(d=d)} ELSE 0 END + i + {_UP})" if own else f"(pos + {d} + i)"
_LOWER = "".join(f" + CASE WHEN shape % 3 >= {j} AND {j} > j AND pos + {{d}} > {t} THEN {n} ELSE 0 END" for j, (t, n) in enumerate(_AFTER))


@query(f"""WITH {_G}, {_BLOCKS}, a AS (
  SELECT sheet, CAST({_F("row")} AS INT) AS row, col, CASE WHEN line = 8 THEN '=F' || {_F("pos")} || CASE WHEN pos % 17 = 0 THEN '/G' ELSE '*G' END || {_F("pos")} ELSE {_grown_text(_MOVED, _F("600"))} END AS text FROM g WHERE shape < 10
  UNION ALL SELECT sheet, row, col, text FROM g WHERE shape = 10
  UNION ALL SELECT g.sheet, CAST(t + i + {_UP} AS INT), col, CASE WHEN line = 8 THEN '=F' || {_COPIED(0)} || CASE WHEN pos % 17 = 0 THEN '/G' ELSE '*G' END || {_COPIED(0)} ELSE {_grown_text(_COPIED, _F("600")).replace("shape", "g.shape")} END
  FROM g JOIN (SELECT sheet, t, n, j, unnest(range(1, n + 1)) AS i FROM k) k ON k.sheet = g.sheet AND k.t = g.row WHERE g.orientation = 'vertical')
SELECT * FROM a""")
def expanded_sheets(spark, sf_dir):
    """Cells and formulas of the grid after one to three blocks of each sheet have grown."""
    o = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 500).alias("no")).distinct()
    after = F.array(*[F.struct(F.lit(j).alias("block"), F.lit(t).alias("template_row"), F.lit(t + 1).alias("insert_at"), F.lit(n).alias("rows_to_add")) for j, (t, n) in enumerate(_AFTER)])
    blocks = o.where("no % 11 < 10").select("no", F.inline(after)).where("block <= (no % 11) % 3")
    blocks = blocks.select(F.concat(F.lit("S"), F.col("no").cast("string")).alias("sheet"), "block", "template_row", "insert_at", "rows_to_add", F.lit(1).alias("c0"), F.lit(12).alias("c1"))
    none = spark.createDataFrame([], "sheet string, kind string, name string, ref string, type string")
    return I.expand(_grid(spark, sf_dir), none, blocks)[0]


# ------------------------------------------------------------------------------ filling

#: source column, target column, role, kind, required, compatibility
TARGETS = [("text", 1, "label", "string", False, "exact"), ("lang", 2, "code", "string", False, "exact"), ("quality", 3, "flag", "integer", True, "numeric_family"), ("toxic", 4, "flag", "string", False, "mismatch"), ("n_chars", 5, "formula_derived", "integer", False, "exact"), ("source", 6, "label", "string", False, "blank_tolerant"), ("url", 7, "label", "string", False, "exact")]
VALIDATIONS = [("B1:B400", "list", '"en,de"'), ("D1:D200", "whole", "0"), ("F100:F300", "list", "Codes!A1:A9")]
MERGES = ["A10:B12", "F150:G151"]

_SRC = "SELECT 'D' || CAST(d.doc_id // 500 AS VARCHAR) AS sheet, CAST(d.doc_id % 500 AS INT) AS pos, text, lang, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic, CAST(n_chars AS VARCHAR) AS n_chars, source FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"
_CELLS = " UNION ALL ".join(f"SELECT sheet, pos + 1 AS row, {c} AS col, sheet || '.{k}' AS source_key, CAST(pos AS BIGINT) AS \"offset\", {k} AS value, '{r}' AS role, '{kind}' AS kind, {str(req).lower()} AS required, '{comp}' AS compatibility FROM s" for k, c, r, kind, req, comp in TARGETS[:-1])
_EMPTY = "trim(coalesce(value, '')) = ''"
_DRY = f"""WITH s AS ({_SRC}), c AS ({_CELLS} UNION ALL SELECT DISTINCT sheet, 1, 7, sheet || '.url', CAST(NULL AS BIGINT), NULL, 'label', 'string', false, 'exact' FROM s),
f AS (SELECT *, concat_ws('; ', CASE WHEN (col = 2 AND row <= 400 OR col = 4 AND row <= 200 OR col = 6 AND row BETWEEN 100 AND 300) AND {_EMPTY} THEN 'validation target would stay empty' END,
  CASE WHEN col <= 2 AND row BETWEEN 10 AND 12 OR col IN (6, 7) AND row BETWEEN 150 AND 151 THEN 'cell lies inside a merged range' END,
  CASE WHEN compatibility = 'mismatch' THEN 'value kinds are incompatible' END) AS failing FROM c),
r AS (SELECT *, CASE WHEN "offset" IS NULL THEN 'source key not present in the source table' WHEN role = 'formula_derived' THEN 'formula-derived target' WHEN {_EMPTY} AND required THEN 'source value is empty for a required target'
  WHEN failing <> '' THEN failing END AS reason FROM f),
x AS (SELECT *, CASE WHEN "offset" IS NOT NULL AND role = 'formula_derived' THEN 'preserved' WHEN reason IS NOT NULL THEN 'blocked' ELSE 'would_write' END AS class FROM r)"""


def _dry(spark, sf_dir):
    key = F.col("doc_id")
    s = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    s = s.select(F.concat(F.lit("D"), F.floor(key / 500).cast("string")).alias("sheet"), (key % 500).cast("long").alias("offset"), "text", "lang", *[F.col(c).cast("string").alias(c) for c in ("quality", "toxic", "n_chars")], "source")
    values = F.array(*[F.struct(F.concat(F.col("sheet"), F.lit(f".{k}")).alias("source_key"), F.col(k).alias("value")) for k, *_ in TARGETS[:-1]])
    source = s.select("offset", F.inline(values))
    sheets = s.select("sheet").distinct()
    columns = [F.struct(F.concat(F.col("sheet"), F.lit(f".{k}")).alias("source_key"), F.lit(c).alias("col"), F.lit(r).alias("target_role"), F.lit(kind).alias("target_kind"), F.lit(req).alias("required"), F.lit(comp).alias("compatibility")) for k, c, r, kind, req, comp in TARGETS]
    mappings = sheets.select("sheet", F.inline(F.array(*columns))).select("*", F.lit("row_block").alias("mode"), F.lit(1).alias("anchor_row"))
    rules = F.array(*[F.struct(F.lit(ref).alias("ref"), F.lit(t).alias("type"), F.lit(f).alias("formula1"), F.lit(i).alias("n")) for i, (ref, t, f) in enumerate(VALIDATIONS)])
    validations = sheets.select("sheet", F.inline(rules))
    merges = sheets.select("sheet", F.explode(F.array(*map(F.lit, MERGES))).alias("ref"))
    return L.dry_run(mappings, source, validations, merges)


@query(f"""{_DRY} SELECT sheet, row, col, source_key, "offset", class, reason, CASE WHEN NOT {_EMPTY} THEN left(value, 60) END AS preview,
  class = 'would_write' AND col = 6 AND row BETWEEN 100 AND 300 AS reference_rule FROM x""")
def dry_run_partition(spark, sf_dir):
    """What a fill of sheets with documents and their labels would do to each cell."""
    return _dry(spark, sf_dir)


@query(f"{_DRY} SELECT sheet, chr(64 + min(col)) || min(row) || ':' || chr(64 + max(col)) || max(row) AS ref FROM x WHERE class = 'would_write' GROUP BY sheet")
def planned_regions(spark, sf_dir):
    return L.planned_region(_dry(spark, sf_dir).where("class = 'would_write'"))


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CASE WHEN p_size BETWEEN 1 AND 40 THEN 'ok' ELSE 'invalid' END WHEN 1 THEN CASE WHEN lower(p_brand) IN ('brand#11', 'brand#12', 'brand#23', 'brand#34') THEN 'ok' ELSE 'invalid' END
  WHEN 2 THEN CASE WHEN length(p_name) <= 8 THEN 'ok' ELSE 'invalid' END WHEN 3 THEN CASE WHEN p_retailprice >= 1000 THEN 'ok' ELSE 'invalid' END ELSE 'unsupported' END AS result FROM part""")
def validation_check(spark, sf_dir):
    """Whole, list, text length and decimal rules over a column each; any other kind of rule is reported as unsupported."""
    rules = [("whole", None, "1", "40", "p_size"), ("list", None, '"Brand#11, Brand#12,Brand#23,Brand#34"', None, "p_brand"), ("textLength", None, "0", "8", "p_name"), ("decimal", "greaterThanOrEqual", "1000", None, "p_retailprice"), ("custom", None, "=A1>2", None, "p_type")]
    rule = F.get(F.array(*[F.struct(*[F.lit(x).cast("string").alias(n) for n, x in zip(("kind", "operator", "first", "second"), r[:4], strict=True)], F.col(r[4]).cast("string").alias("value")) for r in rules]), (F.col("p_partkey") % 5).cast("int"))
    part = table(spark, sf_dir, "part").select("p_partkey", rule.alias("r"))
    return part.select("p_partkey", L.check_validation(*[F.col(f"r.{c}") for c in ("kind", "operator", "first", "second", "value")]).alias("result"))


@query(r"""WITH k AS (SELECT p_partkey, p_size, CASE p_size % 4 WHEN 0 THEN '"a, b,,c"' WHEN 1 THEN 'Codes!A1:A9' WHEN 2 THEN '=LEN(A1)' ELSE 'B2' END AS formula FROM part)
SELECT p_partkey, formula, CASE WHEN p_size % 4 = 0 THEN 3 END AS n_items, p_size % 4 IN (1, 3) AS is_reference FROM k""")
def validation_formulas(spark, sf_dir):
    """Literal lists and references among the formulas of validations."""
    k = F.col("p_size") % 4
    formula = F.when(k == 0, '"a, b,,c"').when(k == 1, "Codes!A1:A9").when(k == 2, "=LEN(A1)").otherwise("B2")
    part = table(spark, sf_dir, "part").select("p_partkey", formula.alias("formula"))
    return part.select("p_partkey", "formula", F.size(L.list_items(F.col("formula"))).alias("n_items"), L.looks_like_reference(F.col("formula")).alias("is_reference")).withColumn("n_items", F.when(F.col("n_items") >= 0, F.col("n_items")))
