"""Sheets put together from rows, blocks and targets, and words of documents: one small case or more for each rule."""

from pyspark.sql import functions as F

from tabulon.operators import assembly as A
from tabulon.operators import documents as D
from tabulon.operators import semantics as K


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def sheet(spark):
    """A title, a gap, a header, three records with a formula column, a total, two styled empty rows."""
    rows = [
        ("S", 1, 1, 1, 0, "t", 1, 1, None, None), ("S", 3, 3, 3, 0, "ttt", 1, 3, None, None), ("S", 4, 3, 1, 1, "tiq", 1, 3, None, None), ("S", 5, 3, 1, 1, "tnq", 1, 3, None, None), ("S", 6, 2, 1, 1, "t.q", 1, 3, None, None),
        ("S", 7, 2, 1, 1, "t.q", 1, 3, None, None), ("S", 9, 0, 0, 0, "", None, None, 2, 3), ("S", 10, 0, 0, 0, "", None, None, 2, 4),
    ]
    df = spark.createDataFrame(rows, "sheet string, row int, nonempty int, text int, formula int, sig string, first_col int, last_col int, styled_min int, styled_max int")
    return df.withColumn("styled", F.when(F.col("nonempty") == 0, 2).otherwise(0))


REGIONS = "sheet string, type string, first_row int, last_row int, ref string"


def regions(spark):
    return spark.createDataFrame([("S", "title", 1, 1, "A1:A1"), ("S", "header", 3, 3, "A3:C3"), ("S", "data", 4, 6, "A4:C6"), ("S", "total", 7, 7, "A7:C7")], REGIONS)


def test_rows(spark):
    df = spark.createDataFrame([("total", 0), ("genel toplam 2024", 0), ("genel toplam 2024", 1), ("ara toplam", 0), ("other", 3)], "label string, formulas int")
    assert [r[0] for r in df.select(A.summary_kind(F.col("label"), F.col("formulas"))).collect()] == ["total", None, "total", "subtotal", None]
    df = spark.createDataFrame([(1, 1, 0, 0, "REPORT", 6), (1, 1, 0, 0, "Report", 6), (1, 1, 0, 1, "Report", 6), (2, 2, 0, 1, "a", 4), (2, 1, 0, 1, "a", 9), (1, 1, 1, 1, "a", 9), (1, 1, 0, 1, None, 9)], "n int, t int, f int, b int, v string, w int")
    assert [r[0] for r in df.select(A.is_title_prefix(*[F.col(c) for c in "ntfbvw"])).collect()] == [True, False, True, False, False, False, False]
    df = spark.createDataFrame([("",), (None,), ("t....",), ("tt...",), ("t..",)], "s string")
    assert [r[0] for r in df.select(A.is_sparse(F.col("s"))).collect()] == [True, True, True, False, True]


def test_spans_titles_and_styles(spark):
    rows = sheet(spark)
    ranges = spark.createDataFrame([("S", 3, 6), ("S", 9, 10)], "sheet string, first_row int, last_row int")
    assert rows_of(A.spans(rows, ranges).select("first_row", "width", "min_col", "max_col", "ref")) == {(3, 3, 1, 3, "A3:C6"), (9, 0, None, None, None)}
    assert rows_of(A.title_bands(rows)) == {("S", 1, 1)}
    assert A.title_bands(rows.where("row > 2")).count() == 0 and A.title_bands(rows.where("row > 1 and row <> 4")).count() == 0
    assert rows_of(A.styled_regions(rows)) == {("S", "input_region", 9, 10, "B9:D10", 4)}


def test_columns(spark):
    rows, headers = sheet(spark), spark.createDataFrame([("S", 3, 3)], "sheet string, first_row int, last_row int")
    assert rows_of(A.column_regions(rows, regions(spark))) == {("S", 1, "data"), ("S", 2, "data"), ("S", 3, "data")}
    assert rows_of(A.body_types(rows, headers)) == {("S", 1, "string"), ("S", 2, "decimal"), ("S", 3, "formula")}
    declared = spark.createDataFrame([("S", 50, 3), ("empty", 9, 9)], "sheet string, max_row int, max_col int")
    assert rows_of(A.dimensions(rows, declared)) == {("S", "A1:C7", 7, 3, 43, 0), ("empty", None, None, None, 9, 9)}
    cells = spark.createDataFrame([("S", 3, 1, "Net"), ("S", 4, 1, " Tutar "), ("S", 3, 2, None), ("S", 4, 2, "Adet")], "sheet string, row int, col int, text string")
    both = spark.createDataFrame([("S", 3, 4)], "sheet string, first_row int, last_row int")
    assert {(c, label) for _, _, c, label in rows_of(A.header_signatures(cells, both))} == {(1, "net | tutar"), (2, "adet")}
    formats = spark.createDataFrame([("#,##0,00",), ("0.00",), ('0,0 "0.0"',), ("0,0",), (None,)], "number_format string")
    assert tuple(A.locale(formats).first()) == ("comma", 3, 1)


def test_counts_and_identities(spark):
    cells = spark.createDataFrame([("S", 1, 2, "formula", "7"), ("S", 4, 1, "formula", None), ("S", 2, 2, "string", None)], "sheet string, row int, col int, kind string, cached string")
    structure = spark.createDataFrame([("S", "merge"), ("S", "merge"), ("S", "validation"), ("T", "table")], "sheet string, kind string")
    assert rows_of(A.sheet_counts(cells, structure)) == {("S", 4, 2, 2, 1, 0, 2, 1, 0), ("T", None, None, 0, 0, 1, 0, 0, 0)}
    one = spark.range(1).select(A.identity(b=F.lit(1), a=F.lit(None).cast("string")), A.identity(a=F.lit(None).cast("string"), b=F.lit(1)), A.identity(a=F.lit("x"), b=F.lit(1))).first()
    assert one[0] == one[1] != one[2]
    parts = [("w", "A|1x1|"), ("w", "B|2x2|t"), ("v", "B|2x2|t"), ("v", "A|1x1|")]
    assert len({r.fingerprint for r in A.structure_fingerprint(spark.createDataFrame(parts, "book string, part string"), ["book"], "part").collect()}) == 1


def test_blocks_and_targets(spark):
    keys = spark.createDataFrame([("S", 1, 60, 0), ("S", 2, 55, 3), ("S", 3, 60, 1)], "sheet string, col int, score int, duplicates int")
    found = A.blocks(regions(spark), keys)
    assert rows_of(found.select("block_id", "archetype", "row_archetype", "key_col", "key_score", "requires_review")) == {
        ("b1", "title_block", "title_row", None, None, None), ("b2", "header_block", "header_row", None, None, None), ("b3", "record_block", "record_row", 1, 60, True), ("b4", "total_block", "total_row", None, None, None),
    }
    columns = spark.createDataFrame([("S", c) for c in (1, 5, 6, 7)], "sheet string, col int")
    slots = spark.createDataFrame([("S", "E9:E12"), ("S", "F3"), ("S", None)], "sheet string, ref string")
    assert rows_of(A.targets(columns, found, slots).drop("sheet")) == {(1, "A", "row_block", 4, "b3", None), (5, "E", "row_block", 9, None, "E9:E12"), (6, "F", "scalar", 3, None, "F3"), (7, "G", "scalar", None, None, None)}
    material = spark.createDataFrame([("S", "h", 1, None, None, None, None), ("S", None, 0, None, None, None, None)], "sheet string, header string, n_cells int, region string, role string, number_format string, type string")
    assert rows_of(A.blank_columns(material, K.is_material(material))) == {("S", 2, 1)}
    ledger = spark.createDataFrame([("p", "r1", "committed", 1), ("p", "r2", "committed", 2), ("p", "r1", "failed", 3)], "plan string, region string, status string, seq int")
    assert A.newest(ledger, "p").first().seq == 2 and A.newest(ledger, "p", "r1").first().seq == 1 and A.newest(ledger, "x").count() == 0


def test_located(spark):
    found = A.blocks(regions(spark), spark.createDataFrame([("S", 1, 60, 0)], "sheet string, col int, score int, duplicates int")).select("sheet", "block_id", "archetype", "ref")
    wanted = spark.createDataFrame([("S", "b3", 1), ("S", "b9", 2), ("T", "b3", 3), ("S", None, 4), ("S", "b3", 5)], "sheet string, block_id string, n int")
    assert rows_of(A.located(wanted, found.union(found), ["sheet", "block_id"]).select("n", "found", "ref")) == {(1, True, "A4:C6"), (2, False, None), (3, False, None), (4, False, None), (5, True, "A4:C6")}
    assert A.located(wanted, found.where("false"), ["sheet", "block_id"]).where("found").count() == 0


def test_words_of_documents(spark):
    runs = spark.createDataFrame([("d", 1, 1, "Dear Mr", "b"), ("d", 1, 2, " Smi", None), ("d", 1, 3, "th, dear Smith", "i"), ("d", 2, 1, "none", None), ("d", 3, 1, None, None)], "doc string, par int, run int, text string, style string")
    got = D.replace_text(runs, ["doc", "par"], "run", "Smith", "Jones")
    assert rows_of(got) == {("d", 1, 1, "Dear Mr", "b", 2), ("d", 1, 2, " Jones", None, 2), ("d", 1, 3, ", dear Jones", "i", 2), ("d", 2, 1, "none", None, 0), ("d", 3, 1, None, None, 0)}
    assert rows_of(D.anchors(runs.where("text is not null"), ["doc", "par"], "run", "Smith")) == {("d", 1, 2, 1, 3, 2)}
    assert rows_of(D.styles_used(runs, "doc")) == {("d", "b", 1), ("d", "i", 1)}
    comments = spark.createDataFrame([("d", "1", "x"), ("d", "2", "y"), ("e", "1", "z")], "doc string, comment_id string, text string")
    assert rows_of(D.without_comment(comments, "doc", comments.where("text = 'x'"))) == {("d", "2", "y"), ("e", "1", "z")}
    names = spark.createDataFrame([("PR.007 Satış Prosedürü R2 01.02.2024", "PR.007", "R2", "PR"), ("DD-12_job description", "DD.12", None, "DD"), ("plain", None, None, None)], "name string, code string, rev string, prefix string")
    title = D.clean_title(F.col("name"), F.col("code"), F.col("rev"))
    assert [tuple(r) for r in names.select(title, D.family(F.col("prefix"), F.lower(title)), D.language(F.col("name"))).collect()] == [("Satış Prosedürü", "PROCEDURE", "TR"), ("job description", "JOB_DESCRIPTION", "EN"), ("plain", "OTHER", "UNKNOWN")]
