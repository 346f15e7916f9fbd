"""Header normalisation, sample text and the label classes of rows."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that mark rows.
TOTAL_WORDS = ["buyuk toplam", "büyük toplam", "genel toplam", "genel toplami", "genel toplamı", "grand total", "grand totals", "toplam", "toplami", "toplamı", "total", "totals"]
SUBTOTAL_WORDS = ["ara toplam", "ara toplam:", "ara toplami", "ara toplamlar", "ara toplamı", "sub total", "subtotal", "subtotals"]
NOTES_PREFIXES = ["not:", "not;", "not ", "notlar", "notes", "note:", "remark", "remarks", "açıklama", "açıklamalar", "aciklama", "aciklamalar"]

SPACES = r"[\u00A0\u202F\u2007\s]+"
EDGES = "[.:;,·•*\"' ]+"


@F.pandas_udf(T.StringType())
def _nfc_lower(s: pd.Series) -> pd.Series:
    """Composed form, then full case folding: what the JVM's lower() lacks."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x).casefold())


def normalize_header(text: Column) -> Column:
    """Comparable form of a header: folded case, single spaces, no edge marks, dashes and underscores as spaces.

    Null stays null. Python is entered only for texts that are not ASCII.
    """
    bare = F.trim(F.regexp_replace(F.replace(text, F.lit("\ufeff"), F.lit("")), SPACES, " "))
    folded = F.when(bare.rlike(r"^[\x00-\x7F]*$"), F.lower(bare)).otherwise(_nfc_lower(F.when(~bare.rlike(r"^[\x00-\x7F]*$"), bare)))
    plain = F.regexp_replace(F.regexp_replace(F.replace(folded, F.lit("\u0307"), F.lit("")), f"^{EDGES}", ""), f"{EDGES}$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[._\\-–—]+", " "), " +", " "))


def truncate_text(text: Column, limit: int = 60) -> Column:
    """At most ``limit`` characters, the last three of a longer text being dots."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 3)), F.lit("..."))).otherwise(text)


def summary_label(norm: Column) -> Column:
    """'subtotal', 'total' or null for a normalised label; longer labels count by their first words."""
    return (
        F.when(norm.isin(SUBTOTAL_WORDS) | norm.startswith("ara toplam"), "subtotal")
        .when(norm.isin(TOTAL_WORDS) | norm.rlike("^(genel toplam|grand total|toplam|total)"), "total")
        .otherwise(F.lit(None).cast("string"))
    )


def looks_like_notes(norm: Column) -> Column:
    return F.coalesce(norm.rlike("^(" + "|".join(NOTES_PREFIXES) + ")"), F.lit(False))


def is_section(text: Column, bold: Column) -> Column:
    """A short label that is bold or in capitals: with digits it needs a space and five characters, without four letters."""
    upper = (F.upper(text) == text) & (F.lower(text) != text)
    digits = text.rlike("[0-9]")
    shape = F.when(digits, text.contains(" ") & (F.length(text) >= 5)).otherwise((F.length(text) >= 4) & text.rlike(r"^[\p{L} ]+$"))
    return F.coalesce((F.length(text) <= 60) & (bold | (upper & shape)), F.lit(False))
