"""Office packages as relations: each file is read once by a task, with zipfile and ElementTree.

Files come as (path, content) from Spark's binaryFile reader; parsing is per file
and the results are ordinary relations. A file that can't be read gives a row
with a status instead of an error.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PKG = "{http://schemas.openxmlformats.org/package/2006/relationships}"

CELLS = "path string, sheet string, row int, col int, kind string, text string, number double, formula string, cached string, style int"
STRUCTURE = "path string, sheet string, kind string, ref string, detail string"
NAMES = "path string, name string, scope int, target string"
PARTS = "path string, part string, bytes long, status string"
PARAGRAPHS = "path string, place int, style string, level int, text string, n_ins int, n_del int"
RUNS = "path string, place int, run int, kind string, author string, bold boolean, italic boolean, text string"
COMMENTS = "path string, id string, author string, text string, anchored string"


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, content and size of files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def _rels(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str, bool]]:
    """rId: (type, target, external) of one part."""
    folder, _, name = part.rpartition("/")
    at = f"{folder}/_rels/{name}.rels".lstrip("/")
    if at not in z.namelist():
        return {}
    out = {}
    for r in ElementTree.fromstring(z.read(at)).iter(f"{PKG}Relationship"):
        target = r.get("Target", "")
        out[r.get("Id")] = (r.get("Type", "").rpartition("/")[2], target.lstrip("/") if target.startswith("/") else f"{folder}/{target}".lstrip("/"), r.get("TargetMode") == "External")
    return out


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str, str]]:
    """(name, part, state) in workbook order."""
    rels = _rels(z, "xl/workbook.xml")
    found = []
    for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet"):
        part = rels.get(s.get(f"{R}id"), ("", "", False))[1]
        found.append((s.get("name"), part, s.get("state", "visible")))
    return found


def _place(ref: str) -> tuple[int, int]:
    letters, row = re.match(r"([A-Z]+)([0-9]+)", ref).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(row), col


def _each(df: DataFrame, read, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows = list(read(path, zipfile.ZipFile(io.BytesIO(content))))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    rows = []  # package_parts() tells what is wrong with such a file
                yield pd.DataFrame(rows, columns=names).astype(object).where(lambda x: x.notna(), None)

    return df.select("path", "content").mapInPandas(run, schema)


def workbook_cells(df: DataFrame) -> DataFrame:
    """Every stored cell: kind (string, number, boolean, error, formula), text, number, formula and its cached value."""

    def read(path, z):
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{S}si")]
        for name, part, _ in _sheets(z):
            for _, c in ElementTree.iterparse(io.BytesIO(z.read(part))):
                if c.tag != f"{S}c":
                    continue
                row, col = _place(c.get("r"))
                t, v, f = c.get("t", "n"), c.find(f"{S}v"), c.find(f"{S}f")
                value = v.text if v is not None else None
                if t == "s" and value is not None:
                    value = shared[int(value)]
                elif t == "inlineStr":
                    value = "".join(x.text or "" for x in c.iter(f"{S}t"))
                style = int(c.get("s", 0))
                if f is not None:
                    yield path, name, row, col, "formula", "=" + (f.text or ""), None, "=" + (f.text or ""), value, style
                elif value is not None:
                    kind = {"s": "string", "inlineStr": "string", "str": "string", "b": "boolean", "e": "error"}.get(t, "number")
                    yield path, name, row, col, kind, value, float(value) if kind == "number" else None, None, None, style
                elif style:
                    yield path, name, row, col, "blank", None, None, None, None, style
                c.clear()

    return _each(df, read, CELLS)


def workbook_structure(df: DataFrame) -> DataFrame:
    """Ranges of each sheet: dimension, merges, filter, pane, hidden rows and columns, validations, conditional formats, tables, links."""

    def read(path, z):
        for name, part, state in _sheets(z):
            root = ElementTree.fromstring(z.read(part))
            yield path, name, "state", None, state
            one = lambda tag, kind, key: [(path, name, kind, e.get(key), None) for e in root.iter(f"{S}{tag}")]
            yield from one("dimension", "dimension", "ref")
            yield from one("mergeCell", "merge", "ref")
            yield from one("autoFilter", "filter", "ref")
            yield from one("pane", "pane", "topLeftCell")
            yield from ((path, name, "hidden_row", e.get("r"), None) for e in root.iter(f"{S}row") if e.get("hidden") == "1")
            yield from ((path, name, "hidden_column", f"{e.get('min')}:{e.get('max')}", None) for e in root.iter(f"{S}col") if e.get("hidden") == "1")
            for e in root.iter(f"{S}dataValidation"):
                yield path, name, "validation", e.get("sqref"), f"{e.get('type', 'none')}:{e.findtext(f'{S}formula1') or ''}"
            for e in root.iter(f"{S}conditionalFormatting"):
                for rule in e.iter(f"{S}cfRule"):
                    yield path, name, "conditional", e.get("sqref"), rule.get("type")
            for kind, target, _ in _rels(z, part).values():
                if kind == "table":
                    table = ElementTree.fromstring(z.read(_resolve(target)))
                    yield path, name, "table", table.get("ref"), table.get("displayName")
                elif kind in ("drawing", "comments", "hyperlink"):
                    yield path, name, kind, None, target

    return _each(df, read, STRUCTURE)


def _resolve(target: str) -> str:
    parts: list[str] = []
    for p in target.split("/"):
        parts = parts[:-1] if p == ".." else [*parts, p]
    return "/".join(parts)


def defined_names(df: DataFrame) -> DataFrame:
    def read(path, z):
        for n in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{S}definedName"):
            scope = n.get("localSheetId")
            yield path, n.get("name"), int(scope) if scope else None, n.text

    return _each(df, read, NAMES)


def package_parts(df: DataFrame) -> DataFrame:
    """Every part of each package with its status: ok, bad_crc, dangling (a relationship without its part), not_zip, empty."""

    def run(frames):
        for pdf in frames:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                if not content:
                    rows.append((path, None, 0, "empty"))
                    continue
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    rows.append((path, None, len(content), "not_zip"))
                    continue
                names = set(z.namelist())
                for i in z.infolist():
                    try:
                        z.read(i)
                        rows.append((path, i.filename, i.file_size, "ok"))
                    except zipfile.BadZipFile:
                        rows.append((path, i.filename, i.file_size, "bad_crc"))
                for part in sorted(names):
                    rows += [(path, _resolve(t), 0, "dangling") for _, t, external in _rels(z, part).values() if not external and _resolve(t) not in names]
            yield pd.DataFrame(rows, columns=["path", "part", "bytes", "status"])

    return df.select("path", "content").mapInPandas(run, PARTS)


def _heading(style: str | None) -> int | None:
    if style in ("Title", "Subtitle"):
        return 0
    m = re.match(r"^(?:Heading|Başlık|Balk) ?([1-9])$", style or "")
    return int(m[1]) if m else None


def document_paragraphs(df: DataFrame) -> DataFrame:
    """Paragraphs in order with style, heading level (null: none), text and tracked changes."""

    def read(path, z):
        styles = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{W}style"):
                name = s.find(f"{W}name")
                styles[s.get(f"{W}styleId")] = name.get(f"{W}val") if name is not None else None
        for i, p in enumerate(ElementTree.fromstring(z.read("word/document.xml")).iter(f"{W}p")):
            own = p.find(f"{W}pPr/{W}pStyle")
            style = own.get(f"{W}val") if own is not None else None
            style = styles.get(style) or style
            level = _heading(style.replace("heading ", "Heading ") if style else None)
            yield path, i, style, level, "".join(t.text or "" for t in p.iter(f"{W}t")), sum(1 for _ in p.iter(f"{W}ins")), sum(1 for _ in p.iter(f"{W}del"))

    return _each(df, read, PARAGRAPHS)


def document_runs(df: DataFrame) -> DataFrame:
    """Runs with their tracked change (ins, del or null), author and style: what revisions are resolved on."""

    def read(path, z):
        for i, p in enumerate(ElementTree.fromstring(z.read("word/document.xml")).iter(f"{W}p")):
            n = 0
            for child in p:
                kind = {f"{W}ins": "ins", f"{W}del": "del"}.get(child.tag)
                for r in [child] if child.tag == f"{W}r" else child.iter(f"{W}r") if kind else ():
                    text = "".join(t.text or "" for t in r if t.tag in (f"{W}t", f"{W}delText"))
                    yield path, i, n, kind, child.get(f"{W}author"), r.find(f"{W}rPr/{W}b") is not None, r.find(f"{W}rPr/{W}i") is not None, text
                    n += 1

    return _each(df, read, RUNS)


def document_comments(df: DataFrame) -> DataFrame:
    """Comments with the text between their marks."""

    def read(path, z):
        if "word/comments.xml" not in z.namelist():
            return
        open_, texts = set(), {}
        for e in ElementTree.fromstring(z.read("word/document.xml")).iter():
            if e.tag == f"{W}commentRangeStart":
                open_.add(e.get(f"{W}id"))
            elif e.tag == f"{W}commentRangeEnd":
                open_.discard(e.get(f"{W}id"))
            elif e.tag == f"{W}t":
                for c in open_:
                    texts[c] = texts.get(c, "") + (e.text or "")
        for c in ElementTree.fromstring(z.read("word/comments.xml")).iter(f"{W}comment"):
            i = c.get(f"{W}id")
            yield path, i, c.get(f"{W}author"), "".join(t.text or "" for t in c.iter(f"{W}t")), texts.get(i, "")

    return _each(df, read, COMMENTS)
