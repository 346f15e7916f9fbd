"""A training corpus out of ``documents``, stage by stage.

Each stage works on all rows that the one before it kept. Null and empty texts
pass the quality stage with the labelled share of good texts as their score and
the deduplication stages as they are; the mix, which counts words, has no use for
them. Rows that are equal in doc_id and text are one document from the second
stage on. Extra columns are carried along, whatever their names. An empty table
stays empty.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.llm.common import WORD, store
from tabulon.llm.mixing import take, with_text
from tabulon.llm.neardup import MinHashParams, document_components
from tabulon.llm.passages import repeated_passages
from tabulon.llm.quality import quality_model, scored
from tabulon.llm.sentencepieces import encode_documents

#: The stages sample, cluster and tokenise: SQL can't express them; tests hold them against brute force.
ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """row (all columns), doc_id and text: no other name can clash with a column of the input."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the votes of their nearest labelled texts call good."""
    model = quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(_packed(docs).select("row", "text"), model, ["row"]).where("predicted = 1").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest by (doc_id, nulls last, text hash), whatever ids the rows have."""
    text_hash = F.xxhash64("text")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", text_hash.alias("h"))
    kept = document_components(docs.select(key.alias("doc_id"), "text"), MinHashParams()).where("kept")
    kept = kept.select(F.col("doc_id.doc_id").alias("id"), F.col("doc_id.h").alias("h")).distinct()
    rows = _packed(docs).join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (text_hash == F.col("h")), "left_semi")
    again = Window.partitionBy("doc_id", "text").orderBy("doc_id")
    return rows.withColumn("n", F.row_number().over(again)).where("n = 1").select("row.*")


def without_words(text: str, spans) -> str:
    """``text`` without the words of the ``spans`` (first word, words); of the white space around a gap the side with more line ends stays."""
    words = [m.span() for m in re.finditer(WORD, text)]
    gone = np.zeros(len(words), bool)
    for span in spans:
        gone[span["first_word"] : span["first_word"] + span["n_words"]] = True
    left = np.flatnonzero(~gone).tolist()
    if not left:
        return ""
    out = [text[: words[0][0]]] if left[0] == 0 else []
    for i, j in zip(left, left[1:] + [None], strict=True):
        out.append(text[slice(*words[i])])
        if j is not None:
            before, after = text[words[i][1] : words[i + 1][0]], text[words[j - 1][1] : words[j][0]]
            out.append(max(before, after, key=lambda x: x.count("\n")))
    return "".join(out) + (text[words[-1][1] :] if left[-1] == len(words) - 1 else "")


def _without_words(text: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else without_words(t, s) for t, s in zip(text, spans, strict=True)], dtype=object)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the stretches of 50 words or more that occur earlier, wherever lines end; texts that keep nothing go.

    What goes has its like before it by (doc_id, text hash, place), so that the
    first one always stays.
    """
    text_hash = F.xxhash64("text")
    spans = repeated_passages(docs).where("not kept")
    gone = spans.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("h")).agg(F.collect_list(F.struct("first_word", "n_words")).alias("spans"))
    rows = _packed(docs).join(gone, F.col("doc_id").eqNullSafe(F.col("id")) & (text_hash == F.col("h")), "left")
    cut = F.pandas_udf(_without_words, "string")(F.when(F.col("spans").isNotNull(), F.col("text")), "spans")
    rows = rows.withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut)).where("spans is null or trim(text) <> ''")
    return with_text(rows, docs, F.col("spans").isNotNull())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and ids of every document of the mix."""
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"], with_ids=True)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("mix", mix_sources),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
