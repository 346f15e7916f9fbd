"""Sets of documents: identity, copies, outline, cross references, revisions, templates."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CODE = r"\b([A-Z]{2,5})[-_. ]?([0-9]{2,5})\b"


def content_classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """sha256, n_copies, first: byte-identical texts as one class; the list of ids stays with the documents."""
    return docs.groupBy(F.sha2(F.col(text), 256).alias("sha256")).agg(F.count("*").alias("n_copies"), F.min(key).alias("first"))


def norm_ref(code: Column) -> Column:
    return F.upper(F.regexp_replace(code, "[-_. ]", ""))


def identity_parts(name: Column) -> dict[str, Column]:
    """code, prefix, revision and date of a file name; an impossible date is null."""
    code = F.regexp_extract(name, r"^([A-Z]{2,5}[-_. ]?[0-9]{2,5}[a-z]?)", 1)
    revs = F.regexp_extract_all(name, F.lit(r"(?:^|[-_ ])[Rr](?:ev)?\.?([0-9]{1,3})"), 1)
    dates = F.regexp_extract_all(name, F.lit(r"([0-9]{1,2}\.[0-9]{1,2}\.[0-9]{2,4})"), 1)
    parts = F.split(F.element_at(dates, -1), r"\.")
    year = F.when(F.length(parts[2]) == 2, F.concat(F.lit("20"), parts[2])).otherwise(parts[2])
    made = F.try_to_date(F.concat_ws("-", year, F.lpad(parts[1], 2, "0"), F.lpad(parts[0], 2, "0")), "yyyy-MM-dd")
    return {
        "code": F.when(code != "", norm_ref(code)), "prefix": F.when(code != "", F.regexp_extract(code, "^[A-Z]+", 0)),
        "revision": F.when(F.size(revs) > 0, F.element_at(revs, -1).cast("int")), "date": F.when(F.size(dates) > 0, made),
    }


def identity(name: Column) -> Column:
    """struct(code, prefix, revision, date, language) of a file name. Where the language isn't asked for, take ``identity_parts``."""
    return F.struct(*[c.alias(k) for k, c in identity_parts(name).items()], language(name).alias("language"))


# Words that tell a language, and the families of documents by prefix.
TR_HINTS = [
    "prosedür", "prosedur", "talimat", "formu", "listesi", "tablosu", "sözleşme", "sozlesme", "beyan", "görev", "gorev", "eğitim", "egitim", "belgelendirme", "başvuru", "basvuru", "uygunsuzluk",
    "politika", "müşteri", "musteri", "denetim", "denetçi", "sertifiker", "sertifikası", "sertifikasi", "tarafsızlık", "gizlilik", "kalite", "sınav", "sinav", "el kitabı",
]
EN_HINTS = [
    "procedure", "instruction", "manual", "certificate", "report", "policy", "agreement", "contract", "application", "checklist", "questionnaire", "declaration", "guide", "training", "exam",
    "answer", "job description", "audit", "certification", "offer", "review", "plan", "minutes", "invitation",
]
FAMILIES = {"PR": "PROCEDURE", "TL": "INSTRUCTION", "TB": "TABLE", "LS": "LIST", "FR": "FORM", "QM": "MANUAL", "KEK": "MANUAL", "OEK": "MANUAL", "PG": "PROGRAM_DOC"}
TITLE_FAMILIES = [("JOB_DESCRIPTION", ["görev tanım", "gorev tanim", "job desc"]), ("PROCESS", ["proses", "process"]), ("POLICY", ["politika", "policy", "beyan", "commitment"])]


def language(name: Column) -> Column:
    """TR or EN, whichever has more hints in the name, BOTH where it says so, else UNKNOWN.

    English hints are whole words, those of seven letters or more also parts of words.
    """
    low, letter = F.lower(name), "a-zçğıöşü"
    count = lambda hits: sum((h.cast("int") for h in hits[1:]), hits[0].cast("int"))
    tr = count([low.contains(h) for h in TR_HINTS])
    # a long hint counts wherever it stands; a short one is looked at more closely where it is there at all
    en = count([low.contains(h) if len(h) >= 7 else low.contains(h) & low.rlike(f"(^|[^{letter}]){h}([^{letter}]|$)") for h in EN_HINTS])
    both = F.upper(name).rlike("TR-EN|TR/EN|EN-TR")
    return F.when(both, "BOTH").when(tr > en, "TR").when(en > tr, "EN").otherwise("UNKNOWN")


def family(prefix: Column, title: Column) -> Column:
    """Family of a document by its prefix; two prefixes leave it to the title."""
    table = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])
    named = F.lit("SUPPORT_DOC")
    for name, words in reversed(TITLE_FAMILIES):
        named = F.when(F.exists(F.array(*map(F.lit, words)), lambda w: title.contains(w)), name).otherwise(named)
    return F.when(prefix.isin("DD", "SD"), named).otherwise(F.coalesce(F.try_element_at(table, prefix), F.lit("OTHER")))


def clean_title(name: Column, code: Column, revision: Column) -> Column:
    """A document's name without its code (PR.007, however written), revision and dates, and with single spaces."""
    parts = F.split(code, r"\.")
    at = F.concat(F.lit("(?i)"), parts[0], F.lit(r"[._\- ]?"), parts[1])
    bare = F.when(code.isNotNull(), F.regexp_replace(name, F.concat(F.lit("^(.*?)"), at), F.lit("$1 "))).otherwise(name)
    bare = F.when(revision.isNotNull(), F.replace(bare, revision, F.lit(" "))).otherwise(bare)
    bare = F.regexp_replace(bare, r"[0-9]{1,2}[._][0-9]{1,2}[._]([0-9]{4}|[0-9]{2})(?![0-9])", " ")
    return F.btrim(F.regexp_replace(bare, r"[\s._\-&()\[\]]+", " "), F.lit(" .-_"))


def outline(docs: DataFrame, key: str, text: str, longest: int = 112) -> DataFrame:
    """Numbered headings: line, number, title and level of lines like '1.2 Scope'."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "body"))
    number, title = F.regexp_extract("body", r"^\s*([0-9]+(\.[0-9]+)*)\.?\s+(\S.*)$", 1), F.regexp_extract("body", r"^\s*([0-9]+(\.[0-9]+)*)\.?\s+(\S.*)$", 3)
    out = lines.where(F.length("body") <= longest).withColumn("number", number).where("number <> ''")
    return out.select(key, "line", "number", title.alias("title"), F.size(F.split("number", r"\.")).alias("level"))


def mentions(docs: DataFrame, key: str, text: str, own: Column | None = None, pattern: str = CODE) -> DataFrame:
    """key, code, n: distinct normalised codes that a text mentions and how often; its own code does not count."""
    found = docs.select(key, F.explode(F.regexp_extract_all(text, F.lit(pattern), 0)).alias("raw"), *([own.alias("own")] if own is not None else []))
    found = found.withColumn("code", norm_ref(F.col("raw")))
    if own is not None:
        found = found.where(~F.col("code").eqNullSafe(norm_ref(F.col("own"))))
    return found.groupBy(key, "code").agg(F.count("*").alias("n"), F.min("raw").alias("shown"))


def current(docs: DataFrame, code: str, order: list[Column]) -> DataFrame:
    """The current revision of each code: the first by ``order``; tentative if two share the first place's date and revision."""
    w = Window.partitionBy(code).orderBy(*order)
    return docs.withColumn("place", F.row_number().over(w)).withColumn("n_revisions", F.count("*").over(Window.partitionBy(code))).where("place = 1").drop("place")


def fill(docs: DataFrame, text: str, values: dict[str, Column]) -> DataFrame:
    """docs with {{token}} replaced, the number filled, and the tokens for which there is no value."""
    pattern = r"\{\{\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}\}"
    tokens = F.regexp_extract_all(text, F.lit(pattern), 1)
    known = F.array(*map(F.lit, values))
    filled = reduce(lambda t, kv: F.regexp_replace(t, F.lit(r"\{\{\s*" + kv[0] + r"\s*\}\}"), F.regexp_replace(kv[1].cast("string"), r"([\\$])", r"\\$1")), values.items(), F.col(text))
    out = docs.withColumn("tokens", tokens).withColumn("filled", filled)
    return out.withColumn("n_filled", F.size(F.filter("tokens", lambda t: F.array_contains(known, t)))).withColumn("unfilled", F.array_sort(F.array_distinct(F.array_except("tokens", known)))).drop("tokens")


def resolve(runs: DataFrame, accept: bool, key: list[str], order: str) -> DataFrame:
    """Text of each paragraph after its tracked changes are accepted or rejected: kind is ins, del or null."""
    drop = "del" if accept else "ins"
    kept = runs.where(F.col("kind").isNull() | (F.col("kind") != drop))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"])
    return kept.groupBy(*key).agg(F.array_join(parts, " ").alias("text"), F.count_if(F.col("kind").isNotNull()).alias("n_resolved"))


def merge_runs(runs: DataFrame, key: list[str], order: str, style: str) -> DataFrame:
    """Neighbouring runs of one style as one: first place, style, text and how many they were."""
    w = Window.partitionBy(*key).orderBy(order)
    new = (~F.col(style).eqNullSafe(F.lag(style).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    marked = runs.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"])
    return marked.groupBy(*key, "run", style).agg(F.min(order).alias("first"), F.array_join(parts, "").alias("text"), F.count("*").alias("n_runs")).drop("run")


def dangling(references: DataFrame, definitions: DataFrame, on: list[str]) -> DataFrame:
    """References without a definition."""
    return references.join(definitions.select(*on).distinct(), on, "left_anti")


def styles_used(paragraphs: DataFrame, key: str, style: str = "style") -> DataFrame:
    """key, style, n: the styles in use and how often."""
    return paragraphs.where(F.col(style).isNotNull()).groupBy(key, style).agg(F.count("*").alias("n"))


def without_comment(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Comments, and marks of comments, without those of ``ids`` (key, comment_id)."""
    return rows.join(ids.select(key, "comment_id").distinct(), [key, "comment_id"], "left_anti")


def _replaced(texts: list[str], old: str, new: str) -> tuple[list[str], int]:
    """Texts of a paragraph's runs: within runs first, then across them, where the first run of a match takes the new text."""
    out, count = [], 0
    for t in texts:
        count += t.count(old)
        out.append(t.replace(old, new))
    at = "".join(out).find(old)
    while at >= 0:
        start = 0
        for i, t in enumerate(out):
            a, b = max(at - start, 0), min(at + len(old) - start, len(t))
            if a < b:
                out[i] = t[:a] + (new if start <= at else "") + t[b:]
            start += len(t)
        count += 1
        at = "".join(out).find(old, at + len(new))
    return out, count


def replace_text(runs: DataFrame, key: list[str], order: str, old: str, new: str) -> DataFrame:
    """runs with ``text`` after ``old`` is ``new``, and ``n``, how often it was in the paragraph (``key``).

    A match inside a run keeps its format; one over several takes that of the run it
    begins in. Paragraphs without a match cost a filter only.
    """
    schema = "struct<texts: array<string>, n: long>"

    def made(texts: pd.Series) -> pd.DataFrame:
        found = [_replaced([x or "" for x in t], old, new) for t in texts]
        return pd.DataFrame({"texts": [f[0] for f in found], "n": [f[1] for f in found]})

    if not old:
        return runs.withColumn("n", F.lit(0).cast("long"))
    others = [c for c in runs.columns if c not in key]
    whole = runs.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in others if c != order]))).alias("r"))
    whole = whole.withColumn("t", F.transform("r", lambda x: x["text"])).withColumn("hit", F.array_join("t", "").contains(old))
    whole = whole.withColumn("m", F.when(F.col("hit"), F.pandas_udf(made, schema)(F.when(F.col("hit"), F.col("t")).otherwise(F.array().cast("array<string>")))))
    texts = F.coalesce(F.col("m.texts"), F.col("t"))
    rows = F.transform("r", lambda x, i: F.struct(*[(F.get(texts, i) if c == "text" else x[c]).alias(c) for c in others]))
    return whole.select(*key, F.coalesce("m.n", F.lit(0)).cast("long").alias("n"), F.inline(rows)).select(*runs.columns, "n")


def anchors(runs: DataFrame, key: list[str], order: str, target: str) -> DataFrame:
    """key, first_run, first_offset, last_run, last_offset: where the first occurrence of ``target`` in a paragraph begins and ends."""
    ordered = Window.partitionBy(*key).orderBy(order)
    at = F.coalesce(F.sum(F.length("text")).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = runs.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "").alias("whole"))
    found = whole.withColumn("a", F.locate(target, F.col("whole")) - 1).where("a >= 0").select(*key, "a", (F.col("a") + len(target)).alias("b"))
    inside = runs.withColumn("start", at).withColumn("stop", F.col("start") + F.length("text")).join(found, key).where("start < b and stop > a")
    first, last = F.min(F.struct(F.col(order).alias("run"), (F.col("a") - F.col("start")).alias("offset"))), F.max(F.struct(F.col(order).alias("run"), (F.col("b") - F.col("start")).alias("offset")))
    out = inside.groupBy(*key).agg(first.alias("f"), last.alias("l"))
    return out.select(*key, F.col("f.run").alias("first_run"), F.col("f.offset").alias("first_offset"), F.col("l.run").alias("last_run"), F.col("l.offset").alias("last_offset"))
