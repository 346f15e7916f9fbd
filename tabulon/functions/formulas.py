"""Reading spreadsheet formulas: references, functions, signature, what is not supported, intent.

One formula is parsed by a small scanner inside an Arrow UDF; everything over
sets of formulas is DataFrame work (see operators.formulas).
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Function groups and codes.
AGGREGATION = ["AVERAGE", "AVERAGEIF", "AVERAGEIFS", "COUNT", "COUNTA", "COUNTIF", "COUNTIFS", "MAX", "MIN", "SUM", "SUMIF", "SUMIFS"]
LOOKUP = ["HLOOKUP", "INDEX", "LOOKUP", "MATCH", "VLOOKUP", "XLOOKUP"]
DATE = ["DATE", "DAY", "EDATE", "EOMONTH", "MONTH", "NETWORKDAYS", "NOW", "TODAY", "WORKDAY", "YEAR"]
VALIDATION = ["EXACT", "ISBLANK", "ISERROR", "ISLOGICAL", "ISNUMBER", "ISTEXT", "LEN"]
CONDITIONAL = ["AND", "IF", "IFNA", "IFS", "NOT", "OR", "SWITCH"]
WRAPPERS = ["IFERROR", "IFNA"]
SURE = ["aggregation", "calculation", "conditional", "date_logic", "lookup", "reference"]
SUBSUMED = [("summary", "aggregation"), ("percentage", "ratio"), ("conditional", "reference"), ("ratio", "calculation"), ("percentage", "calculation")]
LATE_BOUND = ["CELL", "GETPIVOTDATA", "INDIRECT", "INFO", "OFFSET", "RTD"]
DYNAMIC = ["CHOOSECOLS", "CHOOSEROWS", "DROP", "EXPAND", "FILTER", "LAMBDA", "LET", "RANDARRAY", "SEQUENCE", "SORT", "SORTBY", "TAKE", "TEXTSPLIT", "TOCOL", "TOROW", "UNIQUE", "WRAPCOLS", "WRAPROWS", "XLOOKUP", "XMATCH"]

CELL = r"\$?[A-Za-z]{1,3}\$?[1-9][0-9]{0,6}"
TOKEN = re.compile(
    rf"""(?P<text>"(?:[^"]|"")*")
    |(?P<external>(?:'[^']*\[[^\]]+\][^']*'|\[[^\]]+\][A-Za-z0-9_.]*)!{CELL}(?::{CELL})?)
    |(?P<structured>[A-Za-z_][A-Za-z0-9_.]*\[[^\]]*(?:\[[^\]]*\][^\]]*)*\])
    |(?P<ref>(?P<sheet>'(?:[^']|'')+'!|[A-Za-z_][A-Za-z0-9_.]*!)?(?:
        (?P<cells>{CELL}(?::{CELL})?)
       |(?P<cols>\$?[A-Za-z]{{1,3}}:\$?[A-Za-z]{{1,3}})
       |(?P<rows>\$?[1-9][0-9]*:\$?[1-9][0-9]*))(?![A-Za-z0-9_(]))
    |(?P<broken>\#REF!)
    |(?P<function>[A-Za-z_][A-Za-z0-9_.]*)(?=\()
    |(?P<number>[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)
    |(?P<name>[A-Za-z_\\][A-Za-z0-9_.\\]*)
    |(?P<array>\{{[^}}]*\}})
    |(?P<space>\s+)
    |(?P<other>.)""",
    re.X | re.S,
)
POINT = re.compile(r"(\$?)([A-Za-z]{1,3})(\$?)([0-9]+)$")

REF = T.StructType([T.StructField(n, t) for n, t in [("sheet", T.StringType()), ("shape", T.StringType()), ("r0", T.IntegerType()), ("c0", T.IntegerType()), ("r1", T.IntegerType()), ("c1", T.IntegerType()), ("anchored", T.BooleanType()), ("down", T.StringType()), ("along", T.StringType()), ("text", T.StringType())]])
PARSED = T.StructType(
    [
        T.StructField("signature", T.StringType()), T.StructField("refs", T.ArrayType(REF)), T.StructField("functions", T.ArrayType(T.StringType())), T.StructField("outer", T.StringType()),
        T.StructField("view", T.StringType()), T.StructField("n_literals", T.IntegerType()), T.StructField("names", T.ArrayType(T.StringType())), T.StructField("unsupported", T.ArrayType(T.StringType())),
        T.StructField("summary", T.BooleanType()),
    ]
)


def column_number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _point(text: str) -> tuple[int, int, bool, bool]:
    fixed_col, col, fixed_row, row = POINT.match(text).groups()
    return int(row), column_number(col), bool(fixed_row), bool(fixed_col)


def _axis(name: str, value: int, fixed: bool, base: int | None) -> str:
    return f"{name}{value}" if fixed else f"{name}?" if base is None else f"{name}[{value - base}]"


def _moves(start: tuple, end: tuple, axis: int) -> str:
    """What a range does when its formula is copied along ``axis`` (0 down, 1 along the row): by its ends' anchors there."""
    if start[0] == end[0] and start[1] != end[1]:
        return "single_row"
    fixed = start[2 + axis], end[2 + axis]
    return {(True, True): "fixed", (False, False): "rolling", (True, False): "expanding", (False, True): "contracting"}[fixed]


def parse(text: str, row: int | None = None, col: int | None = None) -> dict:
    """One formula, relative to its cell. A text that is no formula has an empty signature.

    ``view`` is the formula with texts and references blanked: what operators are
    looked for in. ``outer`` is its first function. ``summary``: a range in the
    formula's own column ends right above it. A reference's ``down`` and ``along``
    say how it moves when copied, null for a single cell.
    """
    out = {"signature": "", "refs": [], "functions": set(), "outer": None, "view": "", "n_literals": 0, "names": set(), "unsupported": set(), "summary": False}
    if not text or not text.startswith("="):
        return out | {k: [] for k in ("functions", "names", "unsupported")}
    parts, view = [], []
    for m in TOKEN.finditer(text[1:]):
        kind, t = m.lastgroup, m[0]
        if m["ref"]:
            kind = "ref"
        view.append(" " if kind in ("ref", "text", "external") else t)
        if kind == "space":
            continue
        if kind == "ref":
            sheet = (m["sheet"] or "")[:-1]
            sheet = sheet[1:-1].replace("''", "'") if sheet.startswith("'") else sheet.upper()
            head = f"{sheet}!" if sheet else ""
            body = m["cells"] or m["cols"] or m["rows"]
            ends = body.split(":")
            anchored = "$" in body
            if m["cells"]:
                (r0, c0, fr0, fc0), (r1, c1, fr1, fc1) = start, end = _point(ends[0]), _point(ends[-1])
                points = [_axis("R", r, f, row) + _axis("C", c, g, col) for r, c, f, g in (start, end)[: len(ends)]]
                moves = (_moves(start, end, 0), _moves(start, end, 1)) if len(ends) > 1 else (None, None)
                out["refs"].append((sheet, "range" if len(ends) > 1 else "cell", min(r0, r1), min(c0, c1), max(r0, r1), max(c0, c1), anchored, *moves, body))
                out["summary"] |= len(ends) > 1 and col is not None and row is not None and c0 == c1 == col and r1 == row - 1
                parts.append(head + ":".join(points))
            elif m["cols"]:
                a, b = (column_number(e.lstrip("$")) for e in ends)
                out["refs"].append((sheet, "columns", 1, min(a, b), 1048576, max(a, b), anchored, "whole_column", "whole_column", body))
                parts.append(f"{head}#COL{a if '$' in ends[0] else f'[{a - col}]' if col else '?'}")
            else:
                a, b = (int(e.lstrip("$")) for e in ends)
                out["refs"].append((sheet, "rows", min(a, b), 1, max(a, b), 16384, anchored, "whole_row", "whole_row", body))
                parts.append(f"{head}#ROW{a if '$' in ends[0] else f'[{a - row}]' if row else '?'}")
            continue
        if kind == "function":
            name = t.upper()
            out["functions"].add(name)
            out["outer"] = out["outer"] or name
            if name.startswith("_XLFN"):
                out["unsupported"].add("UNSUPPORTED_FUTURE_FUNCTION")
            if name in LATE_BOUND:
                out["unsupported"].add("UNSUPPORTED_LATE_BOUND")
            if name in DYNAMIC:
                out["unsupported"].add("UNSUPPORTED_DYNAMIC_ARRAY")
        elif kind == "external":
            out["unsupported"].add("UNSUPPORTED_EXTERNAL_REFERENCE")
        elif kind == "structured":
            out["unsupported"].add("UNSUPPORTED_STRUCTURED_FORMULA")
        elif kind == "array":
            out["unsupported"].add("UNSUPPORTED_ARRAY_CONSTANT")
        elif kind == "broken":
            out["unsupported"].add("UNSUPPORTED_BROKEN_REFERENCE")
        elif kind == "name" and t.upper() not in ("TRUE", "FALSE"):
            out["names"].add(t.upper())
        out["n_literals"] += kind == "number"
        parts.append(t if kind == "text" else t.upper())
    out["signature"], out["view"] = "".join(parts), "".join(view)
    return out | {k: sorted(out[k]) for k in ("functions", "names", "unsupported")}


#: Formulas that a worker keeps the parse of: sheets made from one template hold the same texts in the same cells.
KEPT = 1 << 14


@lru_cache(KEPT)
def _known(text: str | None, row: int | None, col: int | None) -> dict:
    p = parse(text, row, col)
    return p | {"refs": [dict(zip(REF.names, r, strict=True)) for r in p["refs"]]}


@F.arrow_udf(PARSED)
def _parse(text: pa.Array, row: pa.Array, col: pa.Array) -> pa.Array:
    at: dict[tuple, int] = {}
    index = [at.setdefault(k, len(at)) for k in zip(text.to_pylist(), row.to_pylist(), col.to_pylist(), strict=True)]
    return pa.array([_known(*k) for k in at], to_arrow_type(PARSED)).take(pa.array(index, pa.int32()))


def parse_formula(text: Column, row: Column, col: Column) -> Column:
    """struct(signature, refs, functions, outer, view, n_literals, names, unsupported, summary)."""
    return _parse(text, row.cast("int"), col.cast("int"))


@lru_cache(KEPT)
def translate(text: str, rows: int) -> str:
    """The formula copied ``rows`` down: relative rows move, fixed rows and columns do not; literals stay."""
    def moved(m: re.Match) -> str:
        if not m["ref"]:
            return m[0]
        head = m["sheet"] or ""
        if m["cells"]:
            new = []
            for e in m["cells"].split(":"):
                fc, c, fr, r = POINT.match(e).groups()
                n = int(r) if fr else int(r) + rows
                if n < 1:
                    return "#REF!"
                new.append(f"{fc}{c}{fr}{n}")
            return head + ":".join(new)
        if m["rows"]:
            new = [e if "$" in e else str(int(e) + rows) for e in m["rows"].split(":")]
            return head + ":".join(new)
        return m[0]

    return text[:1] + TOKEN.sub(moved, text[1:]) if text and text.startswith("=") else text


@F.pandas_udf(T.StringType())
def copy_down(text: pd.Series, rows: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else translate(t, int(n)) for t, n in zip(text, rows, strict=True)])


def _signs(p: Column) -> dict[str, Column]:
    """What the rules of intent() and intent_confidence() ask."""
    has = lambda names: F.arrays_overlap(p["functions"], F.array(*map(F.lit, names)))
    is_outer = lambda names: F.coalesce(p["outer"].isin(names), F.lit(False))
    view = p["view"]
    out = {"compare": view.rlike("[<>=]"), "arithmetic": view.rlike(r"[-+*/^]"), "divides": view.contains("/"), "percent": view.contains("*100") | view.contains("%")}
    plain = (F.size(p["functions"]) == 0) & (F.size(p["refs"]) > 0) & ~out["arithmetic"] & ~out["compare"]
    return out | {"has": has, "is_outer": is_outer, "plain": plain}


def intent(p: Column) -> Column:
    """What a parsed formula is for: the first rule that holds, unknown if none does.

    An error wrapper (IFERROR, IFNA) leaves the word to what is inside it; a
    conditional function counts only beside a comparison.
    """
    s = _signs(p)
    has, is_outer = s["has"], s["is_outer"]
    conditional = is_outer([f for f in CONDITIONAL if f not in WRAPPERS]) & s["compare"]
    chain = F.array_contains(p["functions"], "INDEX") & F.array_contains(p["functions"], "MATCH")
    return (
        F.when(p["signature"] == "", "unknown")
        .when(conditional, "conditional")
        .when(is_outer(AGGREGATION), F.when(p["summary"], "summary").otherwise("aggregation"))
        .when(is_outer(LOOKUP) | chain, "lookup")
        .when(has(DATE), "date_logic")
        .when(has(VALIDATION) & (s["compare"] | is_outer(VALIDATION)), "validation_logic")
        .when(s["divides"], F.when(s["percent"], "percentage").otherwise("ratio"))
        .when(s["arithmetic"] & (F.size(p["refs"]) + p["n_literals"] >= 2), "calculation")
        .when(s["plain"], "reference")
        .otherwise("unknown")
    )


def intent_confidence(p: Column, decided: Column) -> Column:
    """HIGH, MEDIUM or LOW: what the intent is worth, one level less where signs of another one are there too."""
    s = _signs(p)
    also = {
        "conditional": s["compare"] & s["has"](CONDITIONAL), "aggregation": s["has"](AGGREGATION), "lookup": s["has"](LOOKUP), "date_logic": s["has"](DATE), "validation_logic": s["has"](VALIDATION),
        "percentage": s["divides"] & s["percent"], "ratio": s["divides"], "calculation": s["arithmetic"], "reference": s["plain"],
    }
    rivals = F.lit(False)
    for name, there in also.items():
        within = [d for d, n in SUBSUMED if n == name]
        rivals = rivals | (there & (decided != name) & ~decided.isin(within or [""]))
    level = F.when(decided.isin(SURE), 2).when(decided == "unknown", 0).otherwise(1)
    return F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), F.greatest(level - F.when(rivals, 1).otherwise(0), F.lit(0)) + 1)


def ref_profile(p: Column) -> Column:
    """struct of counts over a parsed formula's references to cells and ranges: how anchored, how shaped, on which sheet."""
    refs = F.filter(p["refs"], lambda r: r["shape"].isin("cell", "range"))
    dollars = lambda r: F.length(F.regexp_replace(F.split(r["text"], ":")[0], "[^$]", ""))
    count = lambda cond: F.size(F.filter(refs, cond)).cast("long")
    ranged, row, col = (lambda r: r["shape"] == "range"), (lambda r: r["r0"] == r["r1"]), (lambda r: r["c0"] == r["c1"])
    rules = {
        "refs_total": lambda r: F.lit(True), "absolute": lambda r: dollars(r) == 2, "mixed": lambda r: dollars(r) == 1, "relative": lambda r: dollars(r) == 0, "ranges": ranged, "single_refs": lambda r: ~ranged(r),
        "cross_sheet": lambda r: r["sheet"] != "", "same_sheet": lambda r: r["sheet"] == "", "horizontal": lambda r: ranged(r) & row(r) & ~col(r), "vertical": lambda r: ranged(r) & ~row(r) & col(r),
        "single_cell_range": lambda r: ranged(r) & row(r) & col(r), "two_dimensional": lambda r: ranged(r) & ~row(r) & ~col(r),
    }
    return F.struct(*[count(f).alias(n) for n, f in rules.items()])


def formula_kind(p: Column) -> Column:
    """constant, function, comparison, concat, arithmetic by its references, reference or mixed."""
    view, refs = p["view"], p["refs"]
    fixed, cross = F.exists(refs, lambda r: r["anchored"]), F.exists(refs, lambda r: r["sheet"] != "")
    return (
        F.when((F.size(refs) == 0) & (F.size(p["functions"]) == 0), "constant")
        .when(F.size(p["functions"]) > 0, "function")
        .when(view.rlike("[=<>]"), "comparison")
        .when(view.contains("&"), "concat")
        .when(view.rlike("[-+*/^]"), F.when(cross, "cross_sheet_arithmetic").when(fixed, "absolute_arithmetic").otherwise("relative_arithmetic"))
        .when(F.size(refs) > 0, "reference")
        .otherwise("mixed")
    )
