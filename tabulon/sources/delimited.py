"""Delimited and JSON sources, and the operation ledger as text."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tried in this order; the last one reads anything.
ENCODINGS = ["utf-8-sig", "utf-8", "cp1254", "latin-1"]
DELIMITERS = [";", ",", "\t", "|"]


def decode(content: bytes) -> tuple[str, str]:
    """(text, encoding) by the first encoding that fits."""
    for e in ENCODINGS:
        try:
            return content.decode(e), e
        except UnicodeDecodeError:
            continue
    raise AssertionError("latin-1 reads every byte")


def delimiter(sample: Column) -> Column:
    """The most frequent of the known delimiters in a text's first 4096 characters; a comma if there is none."""
    head = F.left(sample, F.lit(4096))
    counts = [F.struct(F.regexp_count(head, F.lit("[" + ("\\t" if d == "\t" else d) + "]")).alias("n"), F.lit(-i).alias("order"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)]
    best = F.greatest(*counts)
    return F.when(best["n"] > 0, best["d"]).otherwise(",")


def delimited_cells(files: DataFrame) -> DataFrame:
    """path, encoding, row, col, text of delimited files of any known encoding; rows without text are dropped, the first is row 1."""

    def run(frames):
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                text, encoding = decode(bytes(content))
                counts = {d: text[:4096].count(d) for d in DELIMITERS}
                best = max(DELIMITERS, key=lambda d: counts[d]) if any(counts.values()) else ","
                rows, n = [], 0
                for record in csv.reader(io.StringIO(text), delimiter=best):
                    if not any(c.strip() for c in record):
                        continue
                    n += 1
                    rows += [(path, encoding, n, i + 1, c) for i, c in enumerate(record)]
                yield pd.DataFrame(rows, columns=["path", "encoding", "row", "col", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, encoding string, row int, col int, text string")


def ledger(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, corrupt lines) of a file with one JSON object a line; a corrupt line never hides the others."""
    lines = spark.read.text(path).where("trim(value) <> ''").withColumn("record", F.from_json("value", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    return lines.where("record._corrupt is null").select("record.*").drop("_corrupt"), lines.where("record._corrupt is not null").select("value")
