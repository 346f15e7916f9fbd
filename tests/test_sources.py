import zipfile

from pyspark.sql import functions as F

from tabulon.operators import documents as D
from tabulon.sources import delimited, ooxml, sinks

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOC = f"""<w:document {W}><w:body>
<w:p><w:pPr><w:pStyle w:val="h1"/></w:pPr><w:r><w:t>Scope</w:t></w:r></w:p>
<w:p><w:r><w:t>Base</w:t></w:r><w:ins w:id="1" w:author="A"><w:r><w:t>ADDED</w:t></w:r></w:ins><w:del w:id="2" w:author="A"><w:r><w:delText>REMOVED</w:delText></w:r></w:del></w:p>
<w:p><w:commentRangeStart w:id="7"/><w:r><w:t>quarterly revenue</w:t></w:r><w:commentRangeEnd w:id="7"/></w:p></w:body></w:document>"""


def docx(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", DOC)
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="h1"><w:name w:val="heading 1"/></w:style></w:styles>')
        z.writestr("word/comments.xml", f'<w:comments {W}><w:comment w:id="7" w:author="B"><w:p><w:r><w:t>check</w:t></w:r></w:p></w:comment></w:comments>')
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="x/image" Target="media/gone.png"/></Relationships>')


def test_workbook_round_trip(spark, tmp_path):
    cells = spark.createDataFrame(
        [("w1", "Data", 1, 1, "string", "Ad & <Soyad>"), ("w1", "Data", 2, 2, "decimal", "1.5"), ("w1", "Data", 3, 2, "formula", "=B2*2"), ("w1", "Özet", 1, 28, "boolean", "true"), ("w2", "S", 1, 1, "integer", None)],
        "workbook string, sheet string, row int, col int, kind string, text string",
    )
    for r in sinks.workbooks(cells).collect():
        (tmp_path / f"{r.workbook}.xlsx").write_bytes(r.content)
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    files = ooxml.files(spark, str(tmp_path), "*.xlsx")
    got = {(r.sheet, r.row, r.col): (r.kind, r.text, r.number) for r in ooxml.workbook_cells(files).collect()}
    assert got == {("Data", 1, 1): ("string", "Ad & <Soyad>", None), ("Data", 2, 2): ("number", "1.5", 1.5), ("Data", 3, 2): ("formula", "=B2*2", None), ("Özet", 1, 28): ("boolean", "1", None)}
    status = {r.path.rpartition("/")[2]: r.status for r in ooxml.package_parts(files).where("status <> 'ok'").collect()}
    assert status == {"bad.xlsx": "not_zip"}
    nothing = spark.createDataFrame([("none.xlsx", bytearray())], "path string, content binary")
    assert ooxml.package_parts(nothing).first().status == "empty" and ooxml.workbook_cells(nothing).count() == 0
    assert {r.sheet for r in ooxml.workbook_structure(files).where("kind = 'state'").collect()} == {"Data", "Özet", "S"}
    assert ooxml.defined_names(files).count() == 0


def test_word_document(spark, tmp_path):
    docx(tmp_path / "a.docx")
    files = ooxml.files(spark, str(tmp_path))
    p = ooxml.document_paragraphs(files).orderBy("place").collect()
    assert [(r.level, r.text, r.n_ins, r.n_del) for r in p] == [(1, "Scope", 0, 0), (None, "BaseADDED", 1, 1), (None, "quarterly revenue", 0, 0)]
    runs = ooxml.document_runs(files).where("place = 1")
    assert D.resolve(runs, True, ["place"], "run").first().text == "Base ADDED"
    assert D.resolve(runs, False, ["place"], "run").first().text == "Base REMOVED"
    c = ooxml.document_comments(files).first()
    assert (c.author, c.text, c.anchored) == ("B", "check", "quarterly revenue")
    assert ooxml.package_parts(files).where("status = 'dangling'").first().part.endswith("media/gone.png")


def test_delimited_and_ledger(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Ad;Tutar\n\nÇiğdem;12,5\n".encode("cp1254"))
    got = delimited.delimited_cells(ooxml.files(spark, str(tmp_path), "*.csv")).collect()
    assert [(r.row, r.col, r.text) for r in sorted(got, key=lambda r: (r.row, r.col))] == [(1, 1, "Ad"), (1, 2, "Tutar"), (2, 1, "Çiğdem"), (2, 2, "12,5")]
    assert got[0].encoding == "cp1254"
    assert spark.range(1).select(delimited.delimiter(F.lit("a|b|c,d"))).first()[0] == "|"
    (tmp_path / "log.jsonl").write_text('{"plan": "p", "seq": 1}\nbroken\n\n{"plan": "q", "seq": 2}\n')
    good, bad = delimited.ledger(spark, str(tmp_path / "log.jsonl"), "plan string, seq long")
    assert {r.plan for r in good.collect()} == {"p", "q"} and [r.value for r in bad.collect()] == ["broken"]


def test_verified_write(spark, tmp_path):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    assert sinks.write_verified(df, f"file://{tmp_path}/t", f"file://{tmp_path}/t.new") == 100
    assert sinks.write_verified(df.limit(0), f"file://{tmp_path}/t", f"file://{tmp_path}/t.new") == 0
    assert spark.read.parquet(f"{tmp_path}/t").count() == 0 and spark.read.parquet(f"{tmp_path}/t.bak").count() == 100
    row = spark.createDataFrame([(None, 1)], "b int, a int")
    assert row.select(sinks.canonical_json(row)).first()[0] == '{"a":1,"b":null}'
