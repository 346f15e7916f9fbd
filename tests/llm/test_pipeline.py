"""Each stage of the pipeline against a plain version of what it should do."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"{long} a\nrest one two three", "s"), (2, f"other words here\n{long} b", "s"), (3, f"{long} a\nrest one two three", "t"), (3, f"{long} a\nrest one two three", "t"), (4, long + " c", "t"), (5, None, None), (None, "no id", "s")]
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(1) for c in ("row", "score", "__gone", "size", "kept")})


def test_near_copies_go(spark, docs):
    got = corpus_pipeline.drop_near_copies(spark, docs, DIR)
    assert got.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == [(False, 1), (False, 5), (True, 0)]
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), DIR).count() == 0


def test_near_copies_go_whatever_their_ids(spark):
    one, two = ([f"{c}{i}" for i in range(90)] for c in "ab")
    text = lambda w, end: " ".join([*w, end])
    rows = [(None, text(one, "x")), (None, text(one, "y")), (8, text(one, "z")), (9, text(two, "x")), (9, text(two, "y")), (9, text(two, "y")), (None, "own text"), (9, "another text"), (None, None), (None, "")]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), DIR).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:3]) for r in got) == [(0, ""), (0, ""), (0, "own"), (8, "a0 "), (9, "ano"), (9, "b0 ")]
    nulls = spark.createDataFrame([(None, text(one, "x")), (None, text(one, "y"))], "doc_id long, text string")
    assert corpus_pipeline.drop_near_copies(spark, nulls, DIR).count() == 1


def test_repeated_passages_go(spark, docs):
    got = {r.doc_id: r for r in corpus_pipeline.drop_repeated_passages(spark, docs.where("doc_id <> 3 or doc_id is null"), DIR).collect()}
    assert got[1].text.startswith("w0") and got[2].text == "other words here\nb" and got[2].n_chars == 18
    assert got[4].text == "c" and got[5].text is None and got[None].text == "no id"


def test_repeated_passages_go_wherever_lines_end(spark):
    shared = [f"p{i}" for i in range(56)]
    rows = [(1, "own words before " + " ".join(shared[:20]) + "\n" + " ".join(shared[20:]) + " and after\nlast"), (2, "second text " + " ".join(shared[:40]) + "\n" + " ".join(shared[40:]) + " goes on\nhere"), (3, "\n".join(shared)), (4, "third text")]
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_repeated_passages(spark, spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long"), DIR).collect()}
    assert got == {1: (rows[0][1], len(rows[0][1])), 2: ("second text goes on\nhere", 24), 4: ("third text", 10)}
    assert corpus_pipeline.without_words(" a\nb c\n\nd e ", [{"first_word": 1, "n_words": 3}]) == " a\ne "


def test_mix_and_encode(spark, docs):
    mixed = corpus_pipeline.mix_sources(spark, docs, DIR)
    assert mixed.columns == docs.columns and mixed.count() > 0
    out = corpus_pipeline.encode(spark, mixed, DIR)
    assert out.count() == mixed.count() and all(r.ids[-1] == 2 and len(r.ids) == r.n_tokens for r in out.collect())


def test_quality_stage_keeps_clean_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = corpus_pipeline.keep_quality(spark, docs, d)
    assert got.columns == docs.columns
    labels = spark.read.parquet(f"{d}/labels.parquet")
    kept = got.join(labels, "doc_id").groupBy("quality").count().collect()
    kept = {r.quality: r["count"] for r in kept}
    all_ = {r.quality: r["count"] for r in labels.join(docs, "doc_id").groupBy("quality").count().collect()}
    assert kept[1] >= 0.98 * all_[1] and kept.get(0, 0) <= 0.1 * all_[0]


def test_whole_pipeline(spark):
    out = corpus_pipeline.run(spark, DIR)
    assert out.count() > 50 and out.columns[:2] == ["doc_id", "n_tokens"]
