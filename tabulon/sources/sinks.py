"""Writing: new workbooks from cells, canonical JSON, and a verified swap of tables."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formulas import column_letters

_TYPES = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{}</Types>'
)
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _package(pdf: pd.DataFrame) -> bytes:
    """One workbook: its sheets in order of name, its cells in order of row and column."""
    out = io.BytesIO()
    names = sorted(pdf["sheet"].unique())
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        put = lambda name, body: z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body)
        sheet_type = "application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"
        put("[Content_Types].xml", _TYPES.format("".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="{sheet_type}"/>' for i in range(len(names)))))
        put("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        put("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        put("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i + 1}" Type="{_REL}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names))) + "</Relationships>")
        for i, n in enumerate(names):
            rows = []
            for r, own in pdf[pdf["sheet"] == n].sort_values(["row", "col"]).groupby("row"):
                cells = []
                for c, kind, text in zip(own["col"], own["kind"], own["text"], strict=True):
                    ref = f"{column_letters(int(c))}{r}"
                    if text is None:
                        continue
                    if kind == "formula":
                        cells.append(f'<c r="{ref}"><f>{escape(text.removeprefix("="))}</f></c>')
                    elif kind in ("integer", "decimal", "number"):
                        cells.append(f'<c r="{ref}"><v>{escape(text)}</v></c>')
                    elif kind == "boolean":
                        cells.append(f'<c r="{ref}" t="b"><v>{1 if text in ("true", "1") else 0}</v></c>')
                    else:
                        cells.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>')
                rows.append(f'<row r="{r}">{"".join(cells)}</row>')
            put(f"xl/worksheets/sheet{i + 1}.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(rows)}</sheetData></worksheet>')
    return out.getvalue()


def workbooks(cells: DataFrame, key: str = "workbook") -> DataFrame:
    """key, content: one package for each workbook. A workbook is one file and so one group; its rows are bounded by the format's grid."""
    schema = T.StructType([cells.schema[key], T.StructField("content", T.BinaryType())])

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [k[0]], "content": [_package(pdf)]})

    return cells.select(key, "sheet", "row", "col", "kind", "text").groupBy(key).applyInPandas(run, schema)


def canonical_json(df: DataFrame, *columns: str) -> Column:
    """A row as JSON with sorted keys and no gaps; nulls stay."""
    return F.to_json(F.struct(*sorted(columns or df.columns)), {"ignoreNullFields": "false"})


def as_csv_text(kind: Column, text: Column) -> Column:
    """A cell as a field: midnight loses its time, booleans are True and False, blank is empty."""
    return (
        F.when(text.isNull() | (kind == "blank"), "")
        .when(kind == "boolean", F.initcap(text))
        .when((kind == "datetime") & text.endswith(" 00:00:00"), F.left(text, F.lit(10)))
        .otherwise(text)
    )


def write_verified(df: DataFrame, path: str, staging: str) -> int:
    """Write beside the target, read back and compare counts and hashes, then swap; returns the number of rows.

    The old table stays until the new one is proven; the swap is a rename of the file system.
    """
    spark = df.sparkSession
    mark = lambda d: d.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*d.columns).cast("decimal(38,0)")).alias("h")).first()
    df.write.mode("overwrite").parquet(staging)
    written, wanted = mark(spark.read.parquet(staging)), mark(df)
    if written != wanted:
        raise RuntimeError(f"QA_FAILED: wrote {written}, wanted {wanted}")
    jvm = spark._jvm
    new, old, backup = (jvm.org.apache.hadoop.fs.Path(p) for p in (staging, path, f"{path}.bak"))
    fs = new.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(old):
        fs.delete(backup, True)
        fs.rename(old, backup)
    if not fs.rename(new, old):
        if fs.exists(backup):
            fs.rename(backup, old)
        raise RuntimeError("ATOMIC_COMMIT_FAILED")
    return written["n"]
