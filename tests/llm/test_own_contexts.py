"""Every word a context of its own: counts, sums of chances and scores against dictionaries."""

import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
from test_operators import DIR, none, odd, words  # noqa: E402, F401

from tabulon.llm import language_model, queries  # noqa: E402
from tabulon.llm.language_model import _names, spread  # noqa: E402


def restaurants(model, known):
    """(customers, tables) by (word, context) of all words that are contexts, prob of every word."""
    customers, tables, prob, n = {}, {}, {}, {}
    by_number = {i: w for w, i in known.words.items()}
    for r in model.state.collect():
        ws = _names(r.words)
        for i, x, c, t in zip(*(spread(y, k).tolist() for y, k in ((r.pos, "<i4"), (r.context, "<u2"), (r.c, "<i8"), (r.t, "<i4")))):
            customers[ws[i], by_number[x]], tables[ws[i], by_number[x]] = c, t
        n.update(zip(ws, spread(r.n, "<i8").tolist()))
        prob.update(zip(ws, spread(r.probs, "<f8").tolist()))
    leaf = set()
    for r in model.leaves.collect():
        ws, xs = _names(r.words), _names(r.contexts)
        assert not leaf & {*xs}  # a context is in one partition only
        leaf |= {*xs}
        for i, x, c, t in zip(spread(r.pos, "<i4").tolist(), np.cumsum(spread(r.context, "<i4")).tolist(), spread(r.c, "<i4").tolist(), spread(r.t, "<i4").tolist()):
            customers[ws[i], xs[x]], tables[ws[i], xs[x]] = c, t
    return customers, tables, prob, n, leaf


def test_every_word_is_a_context_of_its_own(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id < 60")
    held = language_model.every_seventh()
    p = language_model.ModelParams(burn_in=0, samples=1, own=True)
    model = language_model.fit(docs, held, p)
    known = language_model.contexts(docs.where(~held).select("text"), p)
    customers, tables, prob, n, leaf = restaurants(model, known)
    want = {}
    for r in docs.where(~held).select("text").collect():
        ws = ["", *words(r.text), ""]
        for x, w in zip(ws, ws[1:]):
            want[w, x] = want.get((w, x), 0) + 1
    assert customers == want and all(1 <= tables[k] <= c for k, c in want.items())
    assert leaf >= {x for _, x in want} - {*known.words} and len(leaf) > 1000
    of, seated, d = {}, {}, {}
    for own in (True, False):
        some = [c for (_, x), c in customers.items() if (x in known.words) != own]
        d[own] = language_model.discount(sum(c == 1 for c in some), sum(c == 2 for c in some))
    for k, c in customers.items():
        of[k[1]], seated[k[1]] = of.get(k[1], 0) + c, seated.get(k[1], 0) + tables[k]

    def chance(w, x):
        own = x not in known.words
        offer = p.context_strength + d[own] * seated.get(x, 0)
        if not n.get(w):
            return offer * float(model.unknown[0]) / (p.context_strength + of.get(x, 0))
        return (customers.get((w, x), 0) - d[own] * tables.get((w, x), 0) + offer * prob[w]) / (p.context_strength + of.get(x, 0))

    for x in [*sorted(leaf)[:20], *list(known.words)[:5]]:
        assert sum(chance(w, x) for w in n if n[w]) + chance(None, x) == pytest.approx(1)
    got = {r.doc_id: r.score for r in language_model.score(model).collect()}
    for r in docs.collect():
        ws = ["", *words(r.text), ""]
        assert got[r.doc_id] == pytest.approx(sum(np.log10(chance(w, x)) for w, x in zip(ws[1:], ws[:-1])), rel=1e-5)


def test_rare_contexts_tell_words_apart(spark):
    """Contexts far below the share of common words, alike in their last byte: what follows each is learned."""
    rows = [(i, " ".join(f"u{k}a v{k} f{i}x{k}y" for k in range(300))) for i in range(8)] + [(100, "u7a v7"), (101, "u7a v8")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.col("doc_id") >= 100
    got = {r.doc_id: r.score for r in language_model.score(language_model.fit(df, held, language_model.ModelParams(own=True, common=100))).collect()}
    assert got[100] > got[101] + 1
    seen = []
    fit = language_model.fit
    language_model.fit = lambda docs, held, p=language_model.ModelParams(): seen.append(p.own) or fit(docs, held, p)
    try:
        queries.QUERIES["op1_pitman_yor"](spark, DIR)
    finally:
        language_model.fit = fit
    assert seen == [True]


def test_own_contexts_on_odd_rows(odd, none):
    p = language_model.ModelParams(own=True)
    assert language_model.score(language_model.fit(odd, F.lit(False), p)).count() == 12
    assert language_model.score(language_model.fit(none, F.lit(False), p)).count() == 0
    assert {r.score for r in language_model.score(language_model.fit(odd, F.lit(True), p)).collect()} == {0.0}


def test_sweeps_carry_no_dish_of_one_customer_and_scoring_sends_no_names(spark):
    """What travels in every sweep grows with the dishes of several customers alone; chunks' pairs are stored once."""
    rows = [(i, " ".join(f"a{k} b{i}x{k}y" for k in range(400)) + " a1 c a1 c") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    p = language_model.ModelParams(own=True, common=20)
    model = language_model.fit(df, F.lit(False), p)
    dishes = [c for r in model.leaves.collect() for c in spread(r.c, "<i4").tolist()]
    live = [c for r in model.live.collect() for c in spread(r.c, "<i4").tolist()]
    assert sorted(live) == sorted(c for c in dishes if c > 1) and 10 * len(live) < len(dishes)
    assert {*model.asked.columns, *model.asked_leaves.columns}.isdisjoint({"words", "contexts"})
    assert {r.kind for r in spark.read.parquet(model.chunks.stored_at).select("kind").distinct().collect()} == {"stream"}
    known = language_model.contexts(df.select("text"), p)
    customers, tables, *_ = restaurants(model, known)
    assert customers["c", "a1"] == 20 and customers["b3x7y", "a7"] == 1 and tables["b3x7y", "a7"] == 1


def test_partitions_by_words_not_by_the_shuffle_setting(spark):
    """Partitions send each other messages: a small corpus has no more of them for a larger setting."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id < 60")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        model = language_model.fit(docs, language_model.every_seventh(), language_model.ModelParams(burn_in=0, samples=1, own=True))
        assert model.live.count() <= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_numbers_are_stored_by_byte():
    for kind in ("u1", "<u2", "<i4", "<i8", "<f4", "<f8"):
        for x in (np.arange(1000).astype(kind), np.zeros(0, kind), np.arange(6).reshape(2, 3).astype(kind)):
            assert spread(language_model.squeezed(x), kind).tolist() == x.ravel().tolist()
    small = np.random.default_rng(1).integers(0, 256, 100000)
    assert len(language_model.squeezed(small.astype("<i4"))) < 1.02 * 100000
    assert language_model.walked(language_model.steps(np.array([3, 3, 9, -1, 7]))).tolist() == [3, 3, 9, -1, 7]
