"""Source divergence, periodic runs and packing against brute force, and on odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tabulon.llm import divergence, packing, periodic, queries  # noqa: E402

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = ["row", "term", "chunk", "slice", "n", "docs", "k", "part", "value", "rank", "k0", "runs", "start", "length", "period", "piece", "sequence_id", "offset", "open", "first", "bound", "v", "p", "q"]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in EXTRA})


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    again = "ab cd ef gh " * 12
    texts = ["alpha beta gamma", None, "", " \n\t ", long, again, again, "one", "ONE one", "é ñ 中文 😀\x00 \x1e ▁ don't x1y", again + "end " + again]
    rows = [(i if i else None, t, ["en", None, "de"][i % 3], ["a", None, "b", "é"][i % 4], 0) for i, t in enumerate(texts)]
    return frame(spark, [*rows, rows[5], rows[8]])


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


# ------------------------------------------------------------------- divergence


def brute_divergence(rows, least=10, each=10):
    docs = [(lang or "", source or "", [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(divergence.TERM, text or "")]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen, total, by = Counter(), Counter(), defaultdict(Counter)
        for _, s, terms in own:
            seen.update(set(terms))
            total.update(terms)
            by[s].update(terms)
        kept = [t for t in seen if seen[t] >= least]
        v = len(kept)
        prob = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * v) for t in kept}
        p, q = {s: prob(by[s]) for s in by}, prob(total)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in by:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in by if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if by[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, x, k + 1) for k, (x, i) in enumerate(items) if part == "pair" or k < each]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_divergence_against_brute_force(spark, odd):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert rows_of(divergence.source_divergence(docs)) == brute_divergence([(r.text, r.lang, r.source) for r in docs.collect()])
    got = rows_of(divergence.source_divergence(odd, least_docs=2))
    assert got == brute_divergence([(r.text, r.lang, r.source) for r in odd.collect()], least=2)
    assert any(part == "term" for _, _, part, *_ in got)


def test_divergence_does_not_depend_on_slices(spark, monkeypatch):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    want = rows_of(divergence.source_divergence(docs.coalesce(1)))
    monkeypatch.setattr(divergence, "SLICE", 20_000)
    assert rows_of(divergence.source_divergence(docs.repartition(5))) == want


def test_divergence_of_nothing(spark, none, odd):
    assert divergence.source_divergence(none).collect() == []
    bare = divergence.source_divergence(odd, least_docs=1000).collect()
    assert bare and {(r.part, r.value) for r in bare} == {("pair", 0)}
    one = divergence.source_divergence(frame(spark, [(1, None, None, None, 0)]))
    assert one.collect() == []


def test_divergence_against_sql(spark):
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
    want = db.sql(queries.ORACLE["op11_source_divergence"]).fetchall()
    assert rows_of(queries.QUERIES["op11_source_divergence"](spark, DIR)) == sorted(want)


# ---------------------------------------------------------------- periodic runs


def brute_runs(w, least, repeats):
    out = set()
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            x = w[i : j + q]
            if j > i and len(x) >= max(least, repeats * q) and all(any(x[k] != x[k + t] for k in range(len(x) - t)) for t in range(1, q)):
                out.add((i, len(x), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_lyndon(w):
    return [next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w)) - i for i in range(len(w))]


def test_groups_are_lyndon_arrays_and_runs_are_all_found():
    rnd = random.Random(5)
    for _ in range(1500):
        n, letters = rnd.randint(1, 70), rnd.randint(1, 5)
        w = [rnd.randrange(letters) for _ in range(n)]
        if rnd.random() < 0.6:
            a, p = rnd.randrange(n), rnd.randint(1, 9)
            w = [w[min(a + (i - a) % p, n - 1)] if i >= a else w[i] for i in range(n)]
        ranks = np.unique(w, return_inverse=True)[1].tolist()
        assert periodic.lyndon_groups(ranks)[0] == brute_lyndon(ranks)
        for least in (3, 8):
            want = brute_runs(w, least, 3)
            assert periodic.runs_of(np.array(w), least, 3) == want
            cut = [(a + s, k, q) for a, b in periodic.stretches(np.array(w), np.zeros(n, np.int64), least, 3) for s, k, q in periodic.runs_of(np.array(w[a:b]), least, 3)]
            assert sorted(cut, key=lambda r: (r[0], r[2])) == want


def expected(words, least=24, repeats=3):
    runs = brute_runs(words, least, repeats)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest("".join(f"{s},{k},{q}\n" for s, k, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_periodic_query_against_brute_force(spark):
    docs = {r.doc_id: WORD.findall(r.text or "") for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    found = 0
    for r in queries.QUERIES["op12_periodic_runs"](spark, DIR).collect():
        words, h = docs[r.doc_id], zlib.crc32(str(r.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        if n < 1500:
            assert tuple(r[c] for c in COLUMNS) == expected(words)
            found += r.n_runs
    assert found > 3


def test_periodic_runs_of_odd_texts(spark, odd, none):
    assert periodic.periodic_runs(none, ["doc_id"]).collect() == []
    got = sorted(str(tuple(r[c] for c in COLUMNS)) for r in periodic.periodic_runs(odd, ["doc_id"]).collect())
    assert got == sorted(str(expected(WORD.findall(r.text or "")) if len(r.text or "") < 9000 else (0, None, None, None, None, hashlib.sha256(b"").hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())) for r in odd.collect())
    spans = periodic.periodic_runs(odd, ["doc_id", "part"], min_length=6, with_text=True).where("doc_id = 10").first()
    assert [tuple(x) for x in spans.runs] == [(0, 48, 4), (49, 48, 4)] and spans.collapsed == "ab cd ef gh end ab cd ef gh" and spans.part == "x"
    with pytest.raises(ValueError):
        periodic.periodic_runs(odd, ["doc_id"], repeats=2)


def test_reordering_leaves_null_ids_alone(spark):
    docs = frame(spark, [(None, "a b c d " * 9, "en", "a", 0)])
    assert periodic.periodic_runs(docs, ["doc_id"], reorder=queries.folded).first().runs[0].period == 4


# ------------------------------------------------------------------------ packing


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def checked(rows, capacity):
    """Sequences; after their places have been found gapless and within ``capacity``."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= capacity
    return len(by)


def brute_pieces(rows, capacity):
    t, out = tokenizer(), []
    for doc_id, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s : s + capacity]
            out.append((doc_id, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=str)


def test_packing_query(spark):
    got = queries.QUERIES["op13_best_fit_packing"](spark, DIR).collect()
    docs = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == brute_pieces([(d.doc_id, d.text) for d in docs], 2048)
    bound = packing.lower_bound(np.bincount([r.length for r in got], minlength=2049), 2048)
    assert bound <= checked(got, 2048) <= bound + 1


def test_packing_of_odd_texts(spark, odd, none):
    pieces = lambda df: packing.packed_documents(df, public_tokenizers.path("word_bpe_49k.json"), 0, 64, fold=True)
    assert pieces(none).collect() == []
    got = pieces(odd).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == brute_pieces([(d.doc_id, d.text) for d in odd.collect()], 64)
    checked(got, 64)


def exact_bins(lengths, capacity):
    """The least number of sequences, by trying."""
    lengths = sorted(lengths, reverse=True)
    for k in range(1, len(lengths) + 1):

        def place(i, room):
            if i == len(lengths):
                return True
            tried = set()
            for b in range(k):
                if room[b] >= lengths[i] and room[b] not in tried:
                    tried.add(room[b])
                    room[b] -= lengths[i]
                    if place(i + 1, room):
                        return True
                    room[b] += lengths[i]
            return False

        if place(0, [capacity] * k):
            return k
    return 0


def test_bounds_never_pass_the_optimum_and_certify_more_than_sums():
    rnd, better = random.Random(2), 0
    for _ in range(300):
        capacity = rnd.choice([10, 17, 30])
        lengths = [rnd.randint(1 + capacity // rnd.choice([2, 3, 9]), capacity) for _ in range(rnd.randint(1, 8))]
        bound = packing.lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        assert -(-sum(lengths) // capacity) <= bound <= exact_bins(lengths, capacity)
        better += bound > -(-sum(lengths) // capacity)
        _, _, left = packing.best_fit(sorted(lengths, reverse=True), capacity)
        assert len(left) >= bound and min(left) >= 0
    assert better > 50
    assert packing.lower_bound(np.zeros(11, np.int64), 10) == 0


def test_partitions_exchange(spark, monkeypatch):
    """Small partitions can't fill their last sequences alone; exchange brings the sum near the bound over all."""
    rnd = random.Random(9)
    lengths = [rnd.randint(1, 99) for _ in range(3000)]
    places = packing.Places(100)
    tasks = [places.of(np.array(lengths[i : i + 1500])) for i in (0, 1500)]
    assert [tuple(x) for x in (sorted(zip(lengths, np.concatenate(tasks), strict=True)))] == [(n, k) for n in range(1, 100) for k in range(lengths.count(n))]
    own = [packing.Places(100).of(np.array(lengths[i : i + 1500])).tolist() for i in (0, 1500)]
    rows = spark.createDataFrame([(i, i, 0, 0, n, 0, i // 1500, own[i // 1500][i % 1500]) for i, n in enumerate(lengths)], "row long, doc_id long, piece long, start long, length long, ids_crc32 long, task long, place long")
    monkeypatch.setattr(packing, "ROWS", 40)
    got = packing.pack(rows, 100).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    alone = 0
    for part in range(75):
        own = sorted(lengths[part * 40 : part * 40 + 40], reverse=True)
        alone += len(packing.best_fit(own, 100)[2])
    bound = packing.lower_bound(np.bincount(lengths, minlength=101), 100)
    assert bound <= checked(got, 100) <= min(alone, bound * 1.01)
    assert sorted(map(tuple, packing.pack(rows, 100).collect())) == sorted(map(tuple, got))
