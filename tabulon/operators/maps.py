"""Document maps and profiles put together: one JSON document for each workbook out of the relations that describe it.

Documents are built from the bottom up as canonical text: keys in order, no gaps,
lists sorted by place, so that the same facts give the same bytes in whatever order
their rows come. Identities are digests of such texts. Everything is of the size of
layouts: regions, columns and parts of sheets, never cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.refs import index_to_col
from .assembly import structure_fingerprint

KEY = ["book", "sheet"]


def scalar(c: Column) -> Column:
    """A value as JSON text; null as null."""
    return F.coalesce(F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1), F.lit("null"))


def listed(texts: Column) -> Column:
    """JSON texts as a list."""
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def row(*cells: Column) -> Column:
    """Values, of whatever kinds, as a list."""
    return listed(F.array(*map(scalar, cells)))


def record(**parts: Column) -> Column:
    """JSON texts as an object, keys in order."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), parts[k]) for k in sorted(parts)]), F.lit("}"))


def gathered(rows: DataFrame, name: str, text: Column, *order: Column, keys: list[str] = KEY) -> DataFrame:
    """``keys`` and ``name``: the texts of a group as a list, by ``order``, then by text."""
    items = F.struct(*[c.alias(f"o{n}") for n, c in enumerate(order)], text.alias("text"))
    return rows.groupBy(*keys).agg(listed(F.transform(F.array_sort(F.collect_list(items)), lambda x: x["text"])).alias(name))


#: The lists of a sheet: (name, relation, kind of part or None, order, short form for identities, full form).
def _lists() -> list[tuple]:
    c = F.col
    letter = index_to_col(c("col"))
    full = lambda **x: record(**{k: scalar(v) for k, v in x.items()})
    return [
        ("regions", "regions", None, [c("first_row"), c("last_row")], row(c("type"), c("ref")), full(type=c("type"), range=c("ref"), first_row=c("first_row"), last_row=c("last_row"))),
        ("columns", "columns", None, [c("col")], row(letter, c("norm"), c("type"), c("number_format")), full(letter=letter, header=c("header"), normalized_header=c("norm"), data_type=c("type"), number_format=c("number_format"), semantic_role=c("role"), value_kind=c("type"))),
        ("tables", "parts", "table", [c("name"), c("ref")], row(c("name"), c("ref")), full(name=c("name"), ref=c("ref"))),
        ("merged_cells", "parts", "merge", [c("ref")], scalar(c("ref")), full(range=c("ref"))),
        ("validations", "parts", "validation", [c("ref"), c("name")], row(c("ref"), c("name")), full(range=c("ref"), type=c("name"))),
        ("conditional_formats", "parts", "conditional_format", [c("ref"), c("name")], row(c("ref"), c("name")), full(range=c("ref"), kind=c("name"))),
        ("hidden_rows", "parts", "hidden_row", [c("ref").cast("int")], scalar(c("ref").cast("int")), scalar(c("ref").cast("int"))),
        ("hidden_columns", "parts", "hidden_column", [c("ref").cast("int")], scalar(c("ref").cast("int")), scalar(c("ref").cast("int"))),
        ("repeated_structures", "repeated", None, [c("first_row")], row(c("type"), c("signature"), c("occurrences"), c("rows")), full(type=c("type"), signature=c("signature"), occurrences=c("occurrences"), row_count_per_run=c("rows"))),
    ]


def _sheets(facts: dict[str, DataFrame], short: bool) -> DataFrame:
    """book, sheet, pos and text: every sheet as one object."""
    out = facts["sheets"].dropDuplicates(KEY)
    for name, relation, kind, order, brief, full in _lists():
        rows = facts[relation] if kind is None else facts[relation].where(F.col("kind") == kind)
        out = out.join(gathered(rows, name, brief if short else full, *order), KEY, "left")
    labels = gathered(facts["headers"], "labels", row(index_to_col(F.col("col")), F.col("norm")), F.col("col"), keys=[*KEY, "row"])
    heads = gathered(labels, "headers", F.col("labels") if short else record(row=scalar(F.col("row")), labels=F.col("labels")), F.col("row"))
    kinds = facts["formulas"].groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("k"), F.sum("n").alias("total"))
    counts = F.concat(F.lit("{"), F.array_join(F.transform("k", lambda x: F.concat(scalar(x["kind"]), F.lit(":"), scalar(x["n"]))), ","), F.lit("}"))
    kinds = kinds.select(*KEY, record(kinds=counts, total=scalar(F.col("total"))).alias("formula_summary"))
    out = out.join(heads, KEY, "left").join(kinds, KEY, "left")
    lists = {n: F.coalesce(n, F.lit("[]")) for n in [*[x[0] for x in _lists()], "headers"]}
    plain = {n: scalar(F.col(c)) for n, c in (("name", "sheet"), ("visibility", "visibility"), ("used_range", "used_range"), ("freeze_panes", "freeze"), ("autofilter", "filter"))}
    summary = F.coalesce("formula_summary", F.lit('{"kinds":{},"total":0}'))
    return out.select(*KEY, "pos", record(**lists, **plain, formula_summary=summary).alias("text"))


def document_maps(facts: dict[str, DataFrame], dictionary_version: str, schema: str = "1", profile_version: str = "1") -> DataFrame:
    """book, map, profile, content_identity, structure_fingerprint and profile_id of every workbook; map and profile as canonical JSON.

    ``facts``, all with book and sheet: ``sheets`` (pos, visibility, used_range, freeze,
    filter), ``regions`` (type, ref, first_row, last_row), ``headers`` (row, col, norm),
    ``columns`` (col, header, norm, type, number_format, role), ``parts`` (kind, name,
    ref; names of a workbook as kind defined_name), ``formulas`` (kind, n) and
    ``repeated`` (type, signature, occurrences, rows, first_row). Nulls are null in the
    documents, a sheet without some part has an empty list. Rows that are there twice
    are there twice; of repeated sheets one counts. No sheet, no document.
    """
    short, full = _sheets(facts, True), _sheets(facts, False)
    inside = gathered(short, "projection", F.col("text"), F.col("pos"), F.col("sheet"), keys=["book"])
    outside = gathered(full, "sheets", F.col("text"), F.col("pos"), F.col("sheet"), keys=["book"]).join(short.groupBy("book").agg(F.count("*").alias("n_sheets")), "book")
    names = gathered(facts["parts"].where("kind = 'defined_name'"), "names", scalar(F.col("name")), F.col("name"), keys=["book"])
    tables = facts["parts"].where("kind = 'table'").groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "name", "ref"))), ",").alias("tables"))
    shape = facts["sheets"].dropDuplicates(KEY).join(tables, KEY, "left").select("book", F.concat_ws("|", "sheet", F.coalesce("used_range", F.lit("")), F.coalesce("tables", F.lit(""))).alias("part"))
    out = inside.join(outside, "book").join(names, "book", "left").join(structure_fingerprint(shape, ["book"], "part").withColumnRenamed("fingerprint", "structure_fingerprint"), "book")
    version, names = scalar(F.lit(dictionary_version)), F.coalesce("names", F.lit("[]"))
    content = F.sha2(record(dictionary_version=version, doc_map_schema=scalar(F.lit(schema)), sheets=F.col("projection"), defined_names=names), 256)
    out = out.withColumn("content_identity", content)
    known = {"content_identity": scalar(F.col("content_identity")), "structure_fingerprint": scalar(F.col("structure_fingerprint")), "profile_version": scalar(F.lit(profile_version)), "dictionary_version": version}
    out = out.withColumn("profile_id", F.sha2(record(**known), 256))
    workbook = record(sheet_count=scalar(F.col("n_sheets")), defined_names=names, structure_fingerprint=known["structure_fingerprint"])
    doc_map = record(doc_map_schema=scalar(F.lit(schema)), workbook=workbook, sheets=F.col("sheets"))
    profile = record(**known, profile_id=scalar(F.col("profile_id")), sheets=F.col("sheets"))
    return out.select("book", doc_map.alias("map"), profile.alias("profile"), "content_identity", "structure_fingerprint", "profile_id")


def plan_identity(plans: DataFrame, entries: DataFrame, parts: list[str]) -> DataFrame:
    """plan and plan_id: a digest of what a plan is made from (``parts``, columns of ``plans``) and of its entries (plan, sheet, cell, source, write_policy), in whatever order they come."""
    rows = gathered(entries, "entries", row(F.col("sheet"), F.col("cell"), F.col("source"), F.col("write_policy")), F.col("sheet"), F.col("cell"), keys=["plan"])
    whole = record(entries=F.coalesce("entries", F.lit("[]")), **{p: scalar(F.col(p)) for p in parts})
    return plans.join(rows, "plan", "left").select("plan", F.sha2(whole, 256).alias("plan_id"))
