"""Roles of columns from evidence with weights; decisions with margins; key candidates; units."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Weights of the evidence, levels and the margin below which a person decides.
EXACT_TERM, TERM_INSIDE, INSIDE_TERM = 45, 25, 12
HIGH, MEDIUM, MARGIN = 80, 65, 10
AFFINITY = {
    "string": {"label": 20, "identifier": 10, "code": 10, "address": 10, "person_name": 10, "free_text": 10, "period": 8, "flag": 10},
    "integer": {"quantity": 20, "currency": 15, "percent": 15, "identifier": 12, "code": 12, "period": 10},
    "decimal": {"quantity": 20, "currency": 18, "percent": 15},
    "datetime": {"date": 20},
    "date": {"date": 20},
    "boolean": {"flag": 20, "code": 8},
    "formula": {"formula_derived": 40},
    "blank": {"empty_slot": 15},
}
KEYWORDS = {
    "id_words": ["code", "id", "kod", "no", "numara", "numarasi", "numarası", "sira", "sıra"],
    "date_words": ["baslangic", "başlangıç", "bitis", "bitiş", "date", "delivery", "due", "duzenleme", "düzenleme", "issue", "onay", "sevk", "tarih", "teslim", "vade"],
    "percent_symbols": ["%"],
    "note_words": ["aciklama", "aciklamalar", "açıklama", "açıklamalar", "gorus", "görüş", "not", "notlar", "remarks", "yorum"],
    "currency_symbols": ["$", "eur", "tl", "try", "usd", "¢", "£", "€", "₺"],
}
FAMILIES = {"id_words": ("identifier", 20), "date_words": ("date", 25), "percent_symbols": ("percent", 20), "note_words": ("free_text", 20), "currency_symbols": ("currency", 25)}
FORMAT_HINT, CURRENCY_HINTS = 25, ["₺", "tl", "try", "$", "usd", "€", "eur", "£", "gbp"]
DATE_HINT = "(?i)y{2,4}|d{1,2}[./-]m{1,2}|m{1,2}[./-]y{2,4}|m{1,4}[./-]d{1,2}"
FORMAT_UNITS = [("₺", "₺"), ("$", "$"), ("€", "€"), ("%", "%"), ("tl", "₺"), ("try", "₺"), ("usd", "$"), ("eur", "€")]
IN_INPUT_REGION, VALIDATED, GROUPED_NUMBER = 25, 10, 15
UNIT_WORDS = {"tl": "₺", "try": "₺", "usd": "$", "eur": "€", "percent": "%", "kg": "kg", "ton": "ton", "price": "$", "totalprice": "$", "retailprice": "$", "acctbal": "$", "extendedprice": "$"}

#: Terms by role; a dictionary of your own is a parameter (see dictionary()).
TERMS = {
    "identifier": ["id", "key", "custkey", "orderkey", "partkey", "suppkey", "nationkey", "regionkey", "number", "no"],
    "label": ["name", "title", "ürün", "product", "item"],
    "code": ["code", "kod", "brand", "segment", "mktsegment", "status", "orderstatus", "returnflag", "linestatus", "type"],
    "date": ["date", "tarih", "orderdate", "shipdate", "commitdate"],
    "currency": ["price", "amount", "tutar", "fiyat", "acctbal", "totalprice", "retailprice", "extendedprice", "total"],
    "quantity": ["quantity", "adet", "miktar", "size", "count"],
    "percent": ["percent", "discount", "tax", "rate", "oran"],
    "period": ["month", "year", "quarter", "priority", "orderpriority"],
    "free_text": ["comment", "note", "notes", "aciklama", "text"],
}


def dictionary(spark: SparkSession, terms: dict[str, list[str]] | None = None) -> DataFrame:
    """term, role: the first role that names a term keeps it."""
    seen: dict[str, str] = {}
    for role, words in (terms or TERMS).items():
        for w in words:
            seen.setdefault(w, role)
    return spark.createDataFrame(list(seen.items()), "term string, role string")


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """term, role of a dictionary file, read by Spark: a JSON object of role: [terms], alone or under "roles"."""
    text = spark.read.option("wholetext", True).text(path).first()[0]
    found = json.loads(text)
    return dictionary(spark, found.get("roles", found))


def load_rules(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str], dict[str, list[str]]]:
    """(terms, units, keywords) of a dictionary file: what ``evidence`` and ``unit_guess`` take.

    ``units`` in the file: words by unit; of a word that two units name the first keeps
    it. ``keywords``: words by family; a family that the file leaves out keeps its
    built-in words, an unknown one is an error.
    """
    found = json.loads(spark.read.option("wholetext", True).text(path).first()[0])
    units: dict[str, str] = {}
    for unit, words in (found.get("units") or {}).items():
        for w in words:
            units.setdefault(w.casefold(), unit)
    given = found.get("keywords") or {}
    if odd := sorted(set(given) - set(KEYWORDS)):
        raise ValueError(f"unknown families of keywords: {', '.join(odd)}")
    return dictionary(spark, found.get("roles", {})), units, KEYWORDS | given


def dictionary_conflicts(spark: SparkSession, terms: dict[str, list[str]]) -> DataFrame:
    """term, kept, dropped: terms that more than one role names."""
    seen: dict[str, str] = {}
    rows = [(w, seen[w], role) for role, words in terms.items() for w in words if seen.setdefault(w, role) != role]
    return spark.createDataFrame(rows, "term string, kept string, dropped string")


def is_date_format(fmt: Column) -> Column:
    """Whether a number format shows a date: years, or day and month beside each other."""
    return F.coalesce(fmt, F.lit("")).rlike(DATE_HINT)


def format_hints(fmt: Column) -> Column:
    """struct(percent, currency, date): what a number format says of its values."""
    low = F.lower(F.coalesce(fmt, F.lit("")))
    return F.struct(low.contains("%").alias("percent"), F.exists(F.array(*map(F.lit, CURRENCY_HINTS)), lambda h: low.contains(h)).alias("currency"), is_date_format(fmt).alias("date"))


def value_kind(kind: Column, formula_share: Column) -> Column:
    """Kind of a column's values: formula if half of them are."""
    return F.when(formula_share >= 0.5, "formula").otherwise(kind)


def is_material(columns: DataFrame) -> Column:
    """Whether a column says anything: a header, cells, a region, a role, a format or a kind."""
    there = lambda c, *empty: F.coalesce((F.col(c) != "") & ~F.col(c).isin(*empty), F.lit(False))
    return there("header", "") | (F.coalesce("n_cells", F.lit(0)) > 0) | there("region", "") | there("role", "unknown", "empty_slot") | there("number_format", "General") | there("type", "blank")


def required(role: Column, region: Column, in_record_block: Column, kind: Column) -> Column:
    """struct(required, reasons): a proposal; what is derived is never filled."""
    derived = F.coalesce(role.isin("formula_derived", "summary"), F.lit(False))
    reasons = F.array_compact(F.array(F.when(region == "input_region", "region:input_region"), F.when(in_record_block, "inside:record_block"), F.when(kind.isin("string", "integer", "decimal", "datetime"), F.concat(F.lit("data_type:"), kind))))
    said = F.when(derived, F.array(F.concat(F.lit("role:"), role, F.lit(" is derived, not filled")))).when(F.size(reasons) == 0, F.array(F.lit("no positive evidence"))).otherwise(reasons)
    return F.struct((~derived).alias("required"), said.alias("reasons"))


#: Columns of columns that evidence() reads where they are there, and what they are taken for where not.
OPTIONAL = {"number_format": "string", "formula_share": "double", "region": "string", "in_input_region": "boolean", "validated": "boolean"}


def evidence(columns: DataFrame, terms: DataFrame, keywords: dict[str, list[str]] | None = None) -> DataFrame:
    """sheet, col, role, weight, reason: one row for each piece of evidence.

    ``columns``: sheet, col, norm (normalised header), type, n_cells, n_distinct, and what
    there is of OPTIONAL. Header: the dictionary's terms and, once for each family, its
    keywords. Values: what the format shows, kinds that suit a role, formulas, distinct
    texts. Context: an input region, a validation, a numeric column under a grouped header.
    Both sides are as small as headers and word lists; Spark broadcasts them if they are.
    """
    keys = ["sheet", "col"]
    for name, kind in OPTIONAL.items():
        if name not in columns.columns:
            columns = columns.withColumn(name, F.lit(None).cast(kind))
    norm, term = F.col("norm"), F.col("term")
    weight = F.when(norm == term, EXACT_TERM).when(norm.contains(term) & (F.length(term) >= 3), TERM_INSIDE).when(term.contains(norm) & (F.length(norm) >= 5), INSIDE_TERM)
    theta = columns.where("norm <> ''").join(terms, norm.contains(term) | (term.contains(norm) & (F.length(norm) >= 5)))
    header = theta.withColumn("weight", weight).where("weight is not null").select(*keys, "role", "weight", F.concat(F.lit("header:"), term).alias("reason"))
    hit = lambda on, role, weight, reason: F.when(F.coalesce(on, F.lit(False)), F.struct(F.lit(role).alias("role"), (weight if isinstance(weight, Column) else F.lit(weight)).cast("int").alias("weight"), reason.alias("reason")))
    found = []
    for key, words in (keywords or KEYWORDS).items():
        role, weight = FAMILIES[key]
        first = F.get(F.filter(F.array(*map(F.lit, words)), lambda w: norm.contains(w)), F.lit(0))
        found.append(hit(first.isNotNull(), role, weight, F.concat(F.lit(f"keyword:{key}:"), first)))
    hints = format_hints(F.col("number_format"))
    for role in ("percent", "currency", "date"):
        found.append(hit(F.col("number_format").isNotNull() & hints[role], role, FORMAT_HINT, F.concat(F.lit("number_format:"), F.col("number_format"))))
    share = F.coalesce("formula_share", F.lit(0.0))
    found.append(hit((F.col("type") == "formula") | (share >= 0.5), "formula_derived", F.greatest(F.lit(30), F.floor(60 * share)), F.format_string("formula_share:%.2f", share)))
    found.append(hit((F.col("type") == "string") & (F.col("n_cells") >= 3) & (F.col("n_distinct") >= 0.9 * F.col("n_cells")), "identifier", 15, F.lit("values:distinct")))
    found.append(hit(F.col("in_input_region") | (F.col("region") == "input_region"), "empty_slot", IN_INPUT_REGION, F.lit("region:input_region")))
    found.append(hit(F.col("validated") & F.col("type").isin("string", "integer", "decimal"), "identifier", VALIDATED, F.lit("validation:column")))
    found.append(hit(norm.contains("|") & F.col("type").isin("integer", "decimal"), "quantity", GROUPED_NUMBER, F.lit("grouped_header:numeric")))
    others = columns.select(*keys, F.inline(F.array_compact(F.array(*found))))
    pairs = F.create_map(*[F.lit(x) for kind, roles in AFFINITY.items() for x in (kind, json.dumps(roles))])
    kinds = columns.select(*keys, F.explode(F.from_json(pairs[F.col("type")], "map<string,int>")).alias("role", "weight"), F.concat(F.lit("kind:"), F.col("type")).alias("reason"))
    return header.unionByName(others).unionByName(kinds)


def role_scores(found: DataFrame) -> DataFrame:
    """Sum of the weights of each role, 100 at most, with the sorted reasons."""
    per = found.groupBy("sheet", "col", "role")
    return per.agg(F.least(F.lit(100), F.sum("weight")).cast("int").alias("score"), F.array_join(F.array_sort(F.collect_set("reason")), ";").alias("evidence"))


def level(score: Column) -> Column:
    return F.when(score >= HIGH, "HIGH").when(score >= MEDIUM, "MEDIUM").otherwise("LOW")


def decide(scores: DataFrame, keys: list[str], choice: str) -> DataFrame:
    """Best choice of each subject, the second one's score, the margin and whether a person has to look."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), choice)
    ranked = scores.withColumn("rank", F.row_number().over(order)).withColumn("second", F.lead("score").over(order)).where("rank = 1")
    margin = F.col("score") - F.coalesce("second", F.lit(0))
    return ranked.select(*keys, choice, "score", "second", level(F.col("score")).alias("level"), margin.alias("margin"), (F.col("second").isNotNull() & (margin < MARGIN)).alias("requires_review"))


def key_score(columns: DataFrame) -> DataFrame:
    """How well a column serves as a record key; ``columns`` has role, n_cells, non_null, n_distinct.

    Uniqueness is over the cells that hold something; ``validated`` and
    ``in_record_block`` (true where they are not there) count as they do for roles.
    """
    flag = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in columns.columns else F.lit(default)
    ratio = F.col("n_distinct") / F.greatest(F.col("non_null"), F.lit(1))
    score = (
        F.when(F.col("role") == "identifier", 40).otherwise(0)
        + F.when((F.col("non_null") == 0) | (F.col("n_distinct") == 0), 0).when(ratio >= 1, 25).otherwise(F.floor(15 * ratio))
        + F.when((F.col("non_null") == F.col("n_cells")) & (F.col("n_cells") > 0), 15).otherwise(0)
        + F.when(flag("validated", False), 10).otherwise(0)
        + F.when(flag("in_record_block", True), 5).otherwise(0)
    )
    return columns.select("sheet", "col", "header", F.least(F.lit(100), score).cast("int").alias("score"), F.greatest(F.lit(0), F.col("non_null") - F.col("n_distinct")).alias("duplicates"))


def slots(regions: DataFrame, columns: DataFrame) -> DataFrame:
    """sheet, kind, ref, col: input regions and columns whose role is an empty slot."""
    a = regions.where("type = 'input_region'").select("sheet", F.lit("input_slot").alias("kind"), "ref", F.lit(None).cast("int").alias("col"))
    b = columns.where("role = 'empty_slot'").select("sheet", F.lit("input_slot_column").alias("kind"), F.lit(None).cast("string").alias("ref"), F.col("col").cast("int").alias("col"))
    return a.unionByName(b)


def label_report(columns: DataFrame) -> DataFrame:
    """sheet, n_columns, n_labelled, coverage (percent, rounded down) and roles: how many columns have each role."""
    labelled = F.col("role").isNotNull() & (F.col("role") != "unknown")
    per = columns.groupBy("sheet", "role").agg(F.count("*").alias("n"), F.count_if(labelled).alias("known"))
    roles = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "role", F.col("n").cast("string")))), ",")
    out = per.groupBy("sheet").agg(F.sum("n").alias("n_columns"), F.sum("known").alias("n_labelled"), roles.alias("roles"))
    return out.withColumn("coverage", F.floor(100 * F.col("n_labelled") / F.col("n_columns")).cast("int"))


def unit_guess(norm: Column, kind: Column, fmt: Column | None = None, units: dict[str, str] | None = None) -> Column:
    """Unit of a column: of a numeric one by the first word of its header that names one, else by a sign or word in its number format.

    ``units``: unit by word, as ``load_rules`` reads them.
    """
    table = F.create_map(*[F.lit(x) for kv in (UNIT_WORDS if units is None else units).items() for x in kv]) if units is None or units else None
    guess = F.lit(None).cast("string")
    if table is not None:
        words = F.split(F.trim(F.regexp_replace(norm, r"[/\-\s]+", " ")), " ")
        hits = F.filter(F.transform(words, lambda w: F.try_element_at(table, w)), lambda u: u.isNotNull())
        guess = F.when(kind.isin("integer", "decimal") & (F.size(hits) > 0), F.element_at(hits, 1))
    if fmt is None:
        return guess
    low, shown = F.lower(F.coalesce(fmt, F.lit(""))), F.lit(None).cast("string")
    for sign, unit in reversed(FORMAT_UNITS):
        shown = F.when(low.contains(sign), unit).otherwise(shown)
    return F.coalesce(guess, shown)
