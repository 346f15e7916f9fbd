"""The training-data operators against brute force, and on odd inputs: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tabulon.llm import language_model, licences, media, mixing, neardup, neighbours, passages, quality, queries, sentencepieces, token_files  # noqa: E402
from tabulon.llm.common import slices, split_words  # noqa: E402
from tabulon.llm.components import connected_components  # noqa: E402

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


@pytest.fixture(scope="module")
def odd(spark):
    """Every odd case in one table, with columns whose names the operators use themselves."""
    long = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    rows = [(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, long + " tail"), (7, "alpha beta gamma delta epsilon zeta eta theta"), (7, "alpha beta gamma delta epsilon zeta eta theta"), (None, "no id here at all"), (9, "one"), (10, "ONE"), (11, "é ñ 中文 😀\x00 \x1e ▁ ▁▁x")]
    df = spark.createDataFrame([(i, t, None, None if i == 9 else "s", 0) for i, t in rows], SCHEMA)
    extra = ["score", "size", "digest", "node", "row", "part", "target", "held_out", "kept", "taken", "words", "key", "range", "__id", "chunk"]
    return df.withColumns({c: F.lit("x") for c in extra})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ------------------------------------------------------------------ near copies


def brute_components(items: dict, k: int):
    """Smallest key reachable over links of similarity 0.8."""
    sets = {i: ({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()) for i, w in items.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for own in by.values() for n, a in enumerate(own) for b in own[n + 1 :]}
    for a, b in pairs:
        n = len(sets[a] & sets[b])
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_copies_against_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op5_minhash_near_dedup"](spark, DIR).collect()}
    assert got == brute_components({r.doc_id: words(r.text) for r in docs.collect()}, 4)


def test_a_chain_of_near_copies_is_one_component(spark):
    rng = random.Random(2)
    text, rows = [f"t{i}" for i in range(150)], []
    for i in range(60):  # each is near the one before, the ends have little in common
        text = list(text)
        for _ in range(3):
            text[rng.randrange(150)] = f"n{i}{rng.random()}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(f"u{i}{j}" for j in range(80))) for i in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.document_components(spark.createDataFrame(rows, "doc_id long, text string"), neardup.MinHashParams(shingle=4, block=8)).collect()}
    assert got == brute_components({i: words(t) for i, t in rows}, 4)


def test_near_copies_of_odd_rows(odd, none):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.document_components(odd, neardup.MinHashParams(shingle=4)).collect()]
    by = {g[0]: g for g in got}
    assert len(got) == 12 and by[7][2] == 1 and by[6][2] == 5 and by[10] == (10, 1, 9, False)
    assert by[2] == (2, 0, 2, True) and by[3] == (3, 0, 3, True) and by[4][1] == 0 and by[None][2] is None
    assert neardup.document_components(none).count() == 0 and neardup.repeated_paragraphs(none).count() == 0


def test_repeated_paragraphs(spark, odd):
    shared = " ".join(f"p{i}" for i in range(55))
    near = shared.replace("p30", "q30")
    rows = [(1, f"own one\n{shared}"), (2, f"{near}\nown two"), (3, "own three"), (4, " ".join(f"z{i}" for i in range(55)))]
    got = [(r.doc_id, r.part, r.component_doc_id, r.component_part, r.kept) for r in neardup.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == [(1, 1, 1, 1, True), (2, 0, 1, 1, False)]
    assert {r.doc_id for r in neardup.repeated_paragraphs(odd).collect()} == {5, 6}


def brute_passages(texts: dict, size: int):
    """(id, word) of every word that a run of ``size`` words covers which occurs earlier (texts without self-overlap)."""
    first, out = {}, set()
    for key in sorted(texts):
        w = words(texts[key])
        for i in range(len(w) - size + 1):
            if first.setdefault(tuple(w[i : i + size]), (key, i)) != (key, i):
                out |= {(key, j) for j in range(i, i + size)}
    return out


def stretches(rows, kept=False):
    return {(r.doc_id, r.first_word + j) for r in rows if r.kept == kept for j in range(r.n_words)}


def test_repeated_passages_against_brute_force(spark):
    rng = random.Random(4)
    own = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(60)}" for _ in range(n)]
    space = lambda w: "".join(x + rng.choice([" ", " ", " ", "\n", "  "]) for x in w)
    shared = [own(n) for n in (23, 40, 50, 54, 59, 120)]
    texts = {}
    for i in range(60):  # passages start and end inside lines and run over their ends
        parts = [own(rng.randrange(9, 70))]
        for x in rng.sample(shared, rng.randrange(0, 3)):
            parts += [[y.upper() if rng.random() < 0.2 else y for y in x], own(rng.randrange(9, 70))]
        texts[i] = space([y for x in parts for y in x])
    texts[60] = texts[3]
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    found = passages.repeated_passages(rows).collect()
    got, want = stretches(found), brute_passages(texts, 50)
    assert want <= got and len({i for i, _ in want}) > 20
    # nothing else but single words that passages grew over, which have repeated words on either side
    for i, j in got - want:
        assert {(i, j + d) for d in (-1, 1)} & want and len(got - want) < 5
    assert {r.doc_id for r in found if r.kept} - {r.doc_id for r in found if not r.kept}


def test_repeated_passages_on_whole_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = queries.QUERIES["op6_paragraph_dedup"](spark, DIR).collect()
    got, want, loose = stretches(found), brute_passages(texts, 50), brute_passages(texts, 20)
    # a text that repeats itself keeps its first paragraph, where brute force keeps a word
    itself = {i for i, t in texts.items() if (w := words(t)) and len({tuple(w[j : j + 20]) for j in range(len(w) - 19)}) < len(w) - 19}
    assert {x for x in want if x[0] not in itself} <= got and len(want & got) >= 0.9 * len(want) > 0
    assert len(got - loose) <= 0.1 * len(got)


def test_passages_grow_over_single_words_that_differ(spark):
    w = [f"p{i}" for i in range(90)]
    other = [*w[:45], "x", *w[46:]]
    rows = [(1, "before this " + " ".join(w) + " after"), (2, "other " + " ".join(other) + " end"), (3, " ".join(w[:49]) + " too short")]
    got = {(r.doc_id, r.first_word, r.n_words, r.component_doc_id, r.kept) for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 2, 90, 1, True), (2, 1, 90, 1, False)}


def test_fifty_words_in_sequence_hold_a_whole_paragraph():
    p, rng = passages.PassageParams(), np.random.default_rng(1)
    for _ in range(300):
        run = rng.integers(0, 1 << 32, p.min_words, dtype=np.uint32)
        starts = []
        for n in (3, 40):
            text = np.concatenate([rng.integers(0, 1 << 32, n, dtype=np.uint32), run, rng.integers(0, 1 << 32, n, dtype=np.uint32)])
            at = passages.anchors(passages.shingle_hashes(text, 5), np.array([len(text)]), p) - n
            starts.append({a for a in at.tolist() if 0 <= a <= p.min_words - p.unit})
        assert starts[0] & starts[1]


def test_words_are_packed_without_loss():
    rng = np.random.default_rng(3)
    hashes, index = rng.integers(1, 1 << 32, 70_000, dtype=np.uint32), np.minimum(rng.zipf(1.2, 200_000), 70_000) - 1
    assert (passages.unpacked(passages.packed(hashes, index)) == hashes[index]).all()


def test_repeated_passages_of_odd_rows(spark, odd, none):
    assert passages.repeated_passages(none).count() == 0
    assert {(r.doc_id, r.first_word, r.n_words, r.kept) for r in passages.repeated_passages(odd).collect()} == {(5, 0, 30_000, True), (6, 0, 30_000, False)}
    again = spark.createDataFrame([(1, "a " * 200), (2, "b"), (None, " ".join(f"n{i}" for i in range(60)) + " x"), (None, " ".join(f"n{i}" for i in range(60)) + " y")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.first_word, r.n_words, r.kept) for r in passages.repeated_passages(again.union(again)).collect())
    assert got == [(0, 0, 60, False), (0, 0, 60, True), (1, 0, 50, True), (1, 20, 180, False)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (None, 5), (7, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------ language model


def test_language_model_counts_and_perplexity(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op1_pitman_yor"](spark, DIR).collect()}
    tokens = {r.doc_id: [*words(r.text), ""] for r in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    count = {}
    for i, ws in tokens.items():
        for w in ws if not held[i] else ():
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(w in count for w in ws), n)
        assert r.base_score == pytest.approx(sum(np.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in ws))
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    again = {r.doc_id: r.score for r in queries.QUERIES["op1_pitman_yor"](spark, DIR).collect()}
    assert again == pytest.approx({i: r.score for i, r in got.items()})


def test_seating_has_the_right_mean():
    c, a, d = np.full(4000, 300), np.full(4000, 2.0), 0.5
    mean, t = np.mean(language_model.seat(c, a, d, np.random.default_rng(1))), 1.0
    for i in range(1, 300):
        t += 2.0 / (2.0 + i - d * t)
    assert mean == pytest.approx(t, rel=0.03)
    assert language_model.seat(np.array([0, 1, 2]), np.array([1.0, 1.0, 1e12]), 0.5, np.random.default_rng(1)).tolist() == [0, 1, 2]


def test_gibbs_moves_reach_the_right_distribution():
    rng, a, d, n = np.random.default_rng(2), 0.8, 0.4, 20_000
    c = np.array([1, 3] * n)
    t = np.ones(2 * n, np.int64)
    sizes = language_model.tables_of(c, t)
    for _ in range(30):
        sizes, t = language_model.reseat(sizes, t, np.full(2 * n, a), d, 2, rng)
    assert sizes.sum() == c.sum() and (t[::2] == 1).all()
    want = np.array([(1 - d) * (2 - d) * a, 3 * (1 - d) * a**2, a**3])  # of three customers at one, two and three tables
    assert np.bincount(t[1::2], minlength=4)[1:] / n == pytest.approx(want / want.sum(), abs=0.015)
    sizes, t = language_model.settle(sizes, t, np.array([0, 7] * n), np.full(2 * n, a), d, rng)
    assert t[::2].sum() == 0 and sizes.sum() == 7 * n and (t[1::2] >= 1).all()


def test_scores_against_a_plain_predictive(spark):
    """One sample: what the seated restaurants say of every text, token by token from dictionaries."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id < 60")
    p = language_model.ModelParams(burn_in=0, samples=1)
    model = language_model.fit(docs, language_model.every_seventh(), p)
    known = language_model.contexts(docs.where(~language_model.every_seventh()).select("text"), p)
    customers, tables, own, n = {}, {}, {}, {}
    prob = {}
    for r in model.state.collect():
        ws = language_model._names(r.words)
        pos, ctx, c, t = (language_model.spread(x, k).tolist() for x, k in ((r.pos, "<i4"), (r.context, "<u2"), (r.c, "<i8"), (r.t, "<i4")))
        for i, x, y, z in zip(pos, ctx, c, t):
            customers[ws[i], x], tables[ws[i], x] = y, z
        n.update(zip(ws, language_model.spread(r.n, "<i8").tolist()))
        prob.update(zip(ws, language_model.spread(r.probs, "<f8").tolist()))
        own.update(zip(ws, language_model.spread(r.wt, "<i8").tolist()))
    ones, twos = (sum(c == k for c in customers.values()) for k in (1, 2))
    d = language_model.discount(ones, twos)
    of, seated = {}, {}
    for (_, x), c in customers.items():
        of[x] = of.get(x, 0) + c
    for (_, x), t in tables.items():
        seated[x] = seated.get(x, 0) + t
    total = {x: p.context_strength + of.get(x, 0) for x in range(known.n)}

    def chance(w, x):
        offer = p.context_strength + d * seated.get(x, 0)
        if not n.get(w):
            return offer * float(model.unknown[0]) / total[x]
        return (customers.get((w, x), 0) - d * tables.get((w, x), 0) + offer * prob[w]) / total[x]

    for x in list(of)[:20]:  # of all words, and of words not seen, the chances in a context add up to one
        assert sum(chance(w, x) for w in n if n[w]) + chance(None, x) == pytest.approx(1)
    assert all(own[w] >= 1 for w in n if n[w])
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.score for r in language_model.score(model).collect()}
    for i, text in texts.items():
        ws = ["", *words(text), ""]
        want = sum(np.log10(chance(w, x)) for w, x in zip(ws[1:], known.of(ws[:-1]).tolist()))
        assert got[i] == pytest.approx(want, rel=1e-5)


def test_contexts_do_not_depend_on_partitions(spark, monkeypatch):
    """Words are counted over the whole table: the same contexts whatever the cut, and as a plain count has them."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("text")
    every = [w for r in docs.collect() for w in words(r.text)]
    counts = {w: 0 for w in every}
    for w in every:
        counts[w] += 1
    for p in (language_model.ModelParams(), language_model.ModelParams(common=300), language_model.ModelParams(common=10, growth=2.0)):
        share = max(p.common, round(p.growth * len(every) ** 0.5))
        want = {""} | {w for w, n in counts.items() if n * share >= len(every)}
        for cut in (1, 8, 50):
            assert set(language_model.contexts(docs.repartition(cut), p).words) == want
    # words that are common in some chunks only lie between the bounds and are counted again
    p, odd_ones = language_model.ModelParams(common=10, growth=0.0), " ".join(f"x{i}" for i in range(2000))
    rows = spark.createDataFrame([("rare " * 205,), (odd_ones,)] + [("rare " + " ".join(f"y{i}z{k}" for i in range(40)),) for k in range(3)], "text string")
    again = []
    plain = language_model._counted
    monkeypatch.setattr(language_model, "_counted", lambda share, only=None: again.append(only) or plain(share, only))
    for cut in (1, 5):
        assert set(language_model.contexts(rows.repartition(cut), p).words) == ({"", "rare"} if 208 * 10 >= 205 + 2000 + 3 * 41 else {""})
    assert language_model.contexts(rows.limit(0), p).n == 257


def test_scores_do_not_depend_on_partitions(spark):
    """1, 8 and 50 partitions differ by what two seeds differ, not by more."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    held = language_model.every_seventh()
    found = {}
    for cut, seed in ((1, 17), (1, 18), (8, 17), (50, 17)):
        p = language_model.ModelParams(burn_in=1, samples=2, seed=seed)
        found[cut, seed] = {r.doc_id: r.score for r in language_model.score(language_model.fit(docs.repartition(cut), held, p)).collect()}
    base = found.pop((1, 17))
    apart = {k: np.array([abs(v[i] / base[i] - 1) for i in base]) for k, v in found.items()}
    noise = apart.pop((1, 18))
    for a in apart.values():
        assert a.mean() < 2 * noise.mean() + 1e-4 and a.max() < 3 * noise.max() + 1e-3


def test_scores_depend_on_the_order_of_words(spark):
    common = "the cat sat on the mat and the dog sat on the rug "
    rows = [(i, common * 6) for i in range(7)] + [(100, "the cat sat on the mat"), (101, "mat the on sat cat the")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in language_model.score(language_model.fit(df, F.col("doc_id") >= 100)).collect()}
    assert got[100] > got[101] + 1


def test_spelling_sums_to_one():
    s = language_model.Spelling(language_model.ModelParams())
    sizes, cell = language_model.letters(pa.array(["", "ab", "abc", "é"], pa.large_string()))
    assert sizes.tolist() == [1, 3, 4, 3]
    cells, n = np.unique(cell, return_counts=True)
    for _ in range(3):
        s.sample(cells, n, np.random.default_rng(0))
        assert np.allclose(s.levels[0].sum(1), 1)
        index, rows = s.compact()
        assert np.allclose(rows[index], s.levels[0])


def test_language_model_on_odd_rows(odd, none):
    got = language_model.score(language_model.fit(odd, F.lit(False))).collect()
    assert len(got) == 12 and {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {1}
    assert language_model.score(language_model.fit(none, F.lit(False))).count() == 0
    unseen = language_model.score(language_model.fit(odd, F.lit(True))).collect()
    assert len(unseen) == 12 and {r.train_tokens for r in unseen} == {0} and {r.score for r in unseen} == {0.0}


# ------------------------------------------------------------------ neighbours


def test_neighbours_recall(spark):
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = {}
    for r in queries.QUERIES["op2_inverted_multi_index"](spark, DIR).collect():
        got.setdefault(r.query_id, []).append(r)
    hits = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        others = np.flatnonzero(ids != ids[q])
        best = others[np.lexsort((ids[others], d[others]))[:10]]
        own = sorted(got[ids[q]], key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11))
        assert all(r.score == pytest.approx(d[ids == r.vec_id][0]) for r in own)
        hits += len({r.vec_id for r in own} & set(ids[best]))
    assert hits / (10 * len(got)) >= 0.9


def test_neighbours_of_odd_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(100, [0.0, 0.0]), (101, None), (102, [float("nan"), 1.0]), (103, [None, 1.0]), (104, [float("inf"), 1.0]), (105, []), (106, [1.0]), (200, [0.9, 0.1]), (None, [1.0, 1.0])]
    v = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert {r.id for r in v.collect()} == {*range(40), 106, 200}
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in neighbours.nearest(v, v.where("id % 100 = 0"), 10).collect()}
    assert [got[0, k][0] for k in range(1, 11)] == list(range(1, 11)) and [got[200, k][0] for k in range(1, 11)] == list(range(10))
    assert neighbours.nearest(v.limit(0), v.limit(0)).count() == 0


def test_neighbours_beside_repeated_rows(spark):
    rows = [(0, [1.0, 0.0])] * 15 + [(i, [1.0, 0.0]) for i in range(1, 4)] + [(9, [0.9, 0.1])] * 12
    v = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    got = {(r.query_id, r.rank): r.vec_id for r in neighbours.nearest(v, v.where("id = 0"), 10).collect()}
    assert got == {(0, 1): 1, (0, 2): 2, (0, 3): 3, (0, 4): 9}


# ------------------------------------------------------------------ licences


def test_licences(spark, odd, none):
    mit = licences.RULES["MIT"][3]
    rows = [(1, f"text\n{mit}"), (2, "Words.\nReleased under the MIT License."), (3, "x. Licensed under CC BY-NC 4.0. Released under the MIT License. y"), (4, mit[:300]), (5, "some\nLicensed under the Apache License, Version 2.0.")]
    got = {r.doc_id: r.licences for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["MIT"], 2: ["MIT"], 3: ["CC-BY-NC-4.0", "MIT"], 4: [], 5: ["Apache-2.0"]}
    assert all(re.search(licences.HINT, s) for s in licences.compiled()[0])
    wrapped = re.sub(r"((?:\S+ ){7})", r"\1\n", mit)
    lines = [(1, f"Copyright (c) 2020 Someone\n{wrapped}"), (2, "\n".join(f"# {x}" for x in ("Copyright 2020 Someone", *wrapped.split("\n")))), (3, "Words\nReleased under CC0 1.0\r\n\tAll rights\n  reserved"), (4, "Words\nnot all rights\nreserved"), (5, "Words\nLicensed under CC BY\n4.0 or else\nmore" + "\nall rights" * 20000)]
    got = {r.doc_id: r.licences for r in licences.scan_licences(spark.createDataFrame(lines, "doc_id long, text string")).collect()}
    assert got == {1: ["MIT"], 2: ["MIT"], 3: ["CC0-1.0", "Proprietary"], 4: [], 5: []}
    assert licences.scan_licences(odd).count() == 12 and licences.scan_licences(none).count() == 0


# ------------------------------------------------------------------ mixing


def test_budgets_of_sources(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1000), (None, 5)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_budgets(sizes).collect()}
    assert got["b"] == 30 and got["c"] == pytest.approx(1115 - 30 - got["a"] - got[None])
    assert sum(got.values()) == pytest.approx(1115) and got["a"] <= 300 and got[None] <= 15


def test_mix_meets_its_budgets(spark, odd, none):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert rows and sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()))
    taken, target = {}, {}
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    mixed = mixing.take(docs, seed="mix")
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(F.regexp_count("text", F.lit(WORD.pattern)))).first()[0] == pytest.approx(sum(target.values()), rel=0.02)
    assert mixing.mix(odd).count() == 12 and mixing.mix(none).count() == 0 and mixing.take(none).count() == 0


# ------------------------------------------------------------------ tokenizers


def random_texts(n, seed):
    rng = random.Random(seed)
    letters = "aAbBéÉÑΣσςİK'sS1.,,. \n\t  ́-!<|>😀中\x01ß▁\x1e\x00"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["", " ", "<|endoftext|> a", "<|EndOfText|>, b", "A.", " " * 40 + "x", "<s>", "the quick brown fox. The\nquick"]


def test_prefix_table_is_exact():
    table, texts = sentencepieces.PrefixTable(public_tokenizers.path("piece_bpe_32k.model")), random_texts(4000, 1)
    got = []
    for _, _, offsets, ids in sentencepieces.encode_texts(table, pa.array(texts, pa.large_string()), 2):
        got += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert got == [[*x, 2] for x in table.library.encode(texts)]


def test_encode_documents(spark, odd, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sentencepieces.encode_documents(odd, path, ["doc_id", "text"], with_ids=True, with_text=True).collect()
    for r in got:
        ids = [*m.encode(r.text or ""), 2]
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), m.decode(ids))
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert len(got) == 12 and sentencepieces.encode_documents(none, path).count() == 0


def test_encoders_refuse_what_they_cannot_cut():
    with pytest.raises(ValueError):
        token_files.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"), False)  # keeps white space


def test_token_files(spark, odd, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = [(i, x, None, None, 0) for i, x in enumerate(random_texts(600, 2))]
    docs = spark.createDataFrame(texts, SCHEMA).unionByName(odd.select(*SCHEMA.replace(" long", "").replace(" string", "").split(", ")))
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1] or ""))
    got = sorted(token_files.read_token_files(token_files.write_token_files(docs, path, 2, fold=True), with_ids=True).collect(), key=lambda r: r.start)
    at = 0
    for r, (i, x) in zip(got, rows, strict=True):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and r.ids == ids
        at += len(ids)
    assert token_files.read_token_files(token_files.write_token_files(none, path, 2)).count() == 0


# ------------------------------------------------------------------ quality


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    got = queries.QUERIES["op8_quality_votes"](spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert len(got) > 50 and sum(r.predicted == r.quality for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (6, None, 0), (None, 1, 0), (1, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.quality_model(odd, labels)
    got = {r.doc_id: r.score for r in quality.scored(odd.select("doc_id", "text"), model, ["doc_id"]).collect()}
    assert len(got) == 11 and got[2] == got[3] == pytest.approx(model.prior)
    empty = quality.quality_model(none, labels.limit(0))
    assert quality.scored(none, empty, ["doc_id"]).count() == 0
    assert {r.score for r in quality.scored(odd.select("doc_id", "text"), empty, ["doc_id"]).collect()} == {0.5}


def test_quality_votes_against_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    p = quality.VoteParams(sample=64, neighbours=5)
    model = quality.quality_model(docs, labels, p)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    vectors = {i: model.latent(quality.term_weights(pa.array([t], pa.large_string())))[0] for i, t in texts.items()}
    for r in quality.scored(docs.select("doc_id", "text"), model, ["doc_id"]).collect():
        near = sorted(((float(vectors[r.doc_id] @ v), y) for v, y in zip(model.vectors, model.labels, strict=True)), reverse=True)[:5]
        weights = [min(max(c, 1e-6), 1) ** p.power for c, _ in near]
        want = sum(w * y for w, (_, y) in zip(weights, near, strict=True)) / sum(weights) if vectors[r.doc_id].any() else model.prior
        assert r.score == pytest.approx(want, abs=1e-4) and r.predicted == int(r.score >= 0.7)


def test_quality_does_not_depend_on_the_order_of_rows(spark):
    docs = spark.createDataFrame([(1, "b text here"), (1, "a text here"), (2, "other words"), (3, "more words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 1)], "doc_id long, quality int")
    got = {r["__id"]: (r.text, r.label) for r in quality.labelled_sample(docs, labels, quality.VoteParams()).collect()}
    assert got == {1: ("a text here", 0.0), 2: ("other words", 1.0), 3: ("more words", 1.0)}


# ------------------------------------------------------------------ media


def test_media_round_trip(spark, odd, none):
    want = {}
    for r in odd.select("doc_id", "text").collect():
        b = (r.text or "").encode()
        p = b.ljust(max(1, -(-len(b) // 192)) * 192)
        want[r.doc_id] = (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), 64, len(p) // 192)
    got = media.media_columns(odd).collect()
    assert len(got) == 12 and {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.width, r.height) for r in got} == want
    assert len({r.feature for r in got if r.doc_id in (2, 3)}) == 1
    for r in got:
        with open(r.shard.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            assert hashlib.sha256(f.read(r.length)).hexdigest() == r.media_sha256
    import tarfile

    for path in {r.shard for r in got}:
        with tarfile.open(path.removeprefix("file://")) as t:
            assert all(m.name.endswith(".png") for m in t)
    assert media.media_columns(none).count() == 0


# ------------------------------------------------------------------ helpers


def test_slices_keep_every_row():
    texts = ["x" * n for n in (5, 0, 100, 3, 3, 3, 50, 1)] + [None]
    batches = [pa.record_batch({"text": pa.array(texts[i : i + 4], pa.string())}) for i in range(0, 9, 4)]
    for limit in (1, 10, 60, 1000):
        assert [t for b in slices(iter(batches), limit=limit) for t in b.column("text").to_pylist()] == texts


def test_words_of_sliced_columns():
    texts = pa.array(["aé B", " c\x0bd ", "", "Éf\xa0g"], pa.string())
    from tabulon.llm.common import plain_string

    offsets, flat = split_words(plain_string(texts.slice(1)))
    assert offsets.tolist() == [0, 2, 2, 3] and flat.to_pylist() == ["c", "d", "Éf\xa0g"]
