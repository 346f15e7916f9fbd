"""Divergence of sources from their language and from each other, by the terms that they use.

Chunk factorization: texts are counted by whitespace chunks, which repeat far
more than texts do. Each distinct chunk of the corpus is cut into terms once, in
the one task that all its counts are sent to, and its terms go back to the
documents that hold it. Distinct documents and occurrences of a term are counted
slice of text by slice and then added up.
"""

from __future__ import annotations

import json
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_strings, keep, parts, plain_string, ragged_take, scope, slices, split_words, store, tidy, word_codes

#: ASCII letters and everything beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
OTHER = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text in a slice.
SLICE = 16 << 20
#: Probabilities are whole numbers of billionths.
SCALE = 1_000_000_000


# ------------------------------------------------------------------ counting
#
# Words travel in blocks: the distinct strings that a slice has in one bucket, with
# the slice's documents that hold each, and how often. Each block is one row.

BLOCK = "bucket int, slice long, text binary, sizes binary, docs binary, times binary"
NAMES = [x.split()[0] for x in BLOCK.split(", ")]


def _squeeze(data) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes())


def _unsqueeze(data: bytes, kind=None):
    data = zstandard.ZstdDecompressor().decompress(data)
    return data if kind is None else np.frombuffer(data, kind)


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 4
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=NAMES)


def _strings(text: bytes) -> list[bytes]:
    """The strings of a block; they hold no white space."""
    return text.split(b"\n") if text else []


def _dealt(strings: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of strings by bucket, first of each bucket and the end)."""
    of = hash_strings(pa.array(strings, pa.binary())) % np.uint64(buckets) if strings else np.zeros(0, np.uint64)
    order = np.argsort(of, kind="stable")
    return order, np.searchsorted(of[order], np.arange(buckets + 1))


def _cut(strings: list[bytes], where: int, slice_: int, ends: np.ndarray, docs: np.ndarray, times: np.ndarray) -> tuple:
    """One block of strings whose postings are docs[ends[i]:ends[i + 1]]."""
    a, b = int(ends[0]), int(ends[-1])
    return (where, slice_, _squeeze(b"\n".join(strings)), _squeeze(np.diff(ends).astype("<u4")), _squeeze(docs[a:b].astype("<u4")), _squeeze(times[a:b].astype("<u4")))


def _counted(buckets: int):
    """Blocks of chunks, and a head for each slice (bucket -1): lang and source of its documents."""

    def run(batches):
        task, count = TaskContext.get().partitionId() << 32, 0
        for batch in slices(batches, limit=SLICE):
            here = task + count
            count += 1
            heads = [plain_string(batch.column(c)).dictionary_encode() for c in ("lang", "source")]
            names = [json.dumps(h.dictionary.to_pylist()).encode() for h in heads]
            yield _blocks([(-1, here, *map(_squeeze, names), *[_squeeze(h.indices.to_numpy().astype("<u4")) for h in heads])])
            offsets, flat = split_words(plain_string(batch.column("text")), lower=False)
            codes, chunks = word_codes(flat)
            chunks = chunks.cast(pa.large_binary()).to_pylist()
            order, first = _dealt(chunks, buckets)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            docs = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            pairs, times = np.unique(rank[codes] * batch.num_rows + docs, return_counts=True)
            code, doc = np.divmod(pairs, batch.num_rows)
            ends = np.searchsorted(code, np.arange(len(chunks) + 1))
            rows = [_cut([chunks[i] for i in order[a:b]], w, here, ends[a : b + 1], doc, times) for w, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)) if b > a]
            if rows:
                yield _blocks(rows)

    return run


class ChunkTerms:
    """The terms of chunks: each distinct chunk that a task meets is cut once."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.names: dict[bytes, int] = {}
        self.starts, self.sizes, self.terms, self.times = array("q"), array("q"), array("q"), array("q")

    def _cut(self, chunks: list[bytes]) -> None:
        plain = pc.replace_substring_regex(pc.ascii_lower(pa.array([c.decode() for c in chunks], pa.large_string())), OTHER, " ")
        offsets, flat = split_words(plain, lower=False)
        ids = [self.names.setdefault(t, len(self.names)) for t in flat.cast(pa.large_binary()).to_pylist()]
        ends = offsets.tolist()
        for c, a, b in zip(chunks, ends[:-1], ends[1:], strict=True):
            self.known[c] = len(self.starts)
            self.starts.append(len(self.terms))
            if b - a == 1:
                self.terms.append(ids[a])
                self.times.append(1)
            else:
                own = Counter(ids[a:b])
                self.terms.extend(own.keys())
                self.times.extend(own.values())
            self.sizes.append(len(self.terms) - self.starts[-1])

    def of(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of terms of each chunk, their ids, how often the chunk holds each)."""
        new = [c for c in chunks if c not in self.known]
        if new:
            self._cut(new)
        at = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        starts, sizes, terms, times = (np.frombuffer(y, np.int64) if len(y) else np.zeros(0, np.int64) for y in (self.starts, self.sizes, self.terms, self.times))
        place = ragged_take(starts[at], sizes[at])
        return sizes[at], terms[place], times[place]


def _summed(term: np.ndarray, doc: np.ndarray, n: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, document, sum of n) of distinct pairs, by term."""
    pairs, at = np.unique(term * n_docs + doc, return_inverse=True)
    total = np.bincount(at, weights=n, minlength=len(pairs)).astype(np.int64)
    return (*np.divmod(pairs, n_docs), total)


def _tokenized(batches):
    """Blocks of chunks as blocks of terms, slice by slice."""
    cut = ChunkTerms()
    back: list[bytes] = []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] < 0:
                yield _blocks([tuple(row[c] for c in NAMES)])
                continue
            chunks = _strings(_unsqueeze(row["text"]))
            sizes, docs, times = (_unsqueeze(row[c], "<u4").astype(np.int64) for c in ("sizes", "docs", "times"))
            own, term, k = cut.of(chunks)
            if not len(term):
                continue
            back += list(cut.names)[len(back) :] if len(cut.names) > len(back) else []
            chunk = np.repeat(np.arange(len(chunks)), own)
            first = np.cumsum(sizes) - sizes
            place = ragged_take(first[chunk], sizes[chunk])
            local, at = np.unique(term, return_inverse=True)
            t, d, n = _summed(np.repeat(at, sizes[chunk]), docs[place], times[place] * np.repeat(k, sizes[chunk]), int(docs.max()) + 1)
            ends = np.searchsorted(t, np.arange(len(local) + 1))
            yield _blocks([_cut([back[i] for i in local.tolist()], row["bucket"], row["slice"], ends, d, n)])


def _by_slice(buckets: int):
    """One slice: distinct documents and occurrences of each term by (lang, source), as blocks for the terms' buckets.

    In these blocks ``docs`` holds lang, source, distinct documents one after the
    other for each entry, and ``times`` the occurrences; the names follow in ``text``.
    """

    def merge(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        head = next(r for r in rows if r["bucket"] < 0)
        names = [json.loads(_unsqueeze(head[c])) for c in ("text", "sizes")]
        lang, source = (_unsqueeze(head[c], "<u4").astype(np.int64) for c in ("docs", "times"))
        body = [r for r in rows if r["bucket"] >= 0]
        if not body:
            return pa.Table.from_batches([_blocks([])])
        known: dict[bytes, int] = {}
        terms, docs, times = [], [], []
        for r in body:
            ids = np.array([known.setdefault(t, len(known)) for t in _strings(_unsqueeze(r["text"]))], np.int64)
            terms.append(np.repeat(ids, _unsqueeze(r["sizes"], "<u4")))
            docs.append(_unsqueeze(r["docs"], "<u4").astype(np.int64))
            times.append(_unsqueeze(r["times"], "<u4"))
        strings = list(known)
        order, first = _dealt(strings, buckets)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        t, d, n = _summed(rank[np.concatenate(terms)], np.concatenate(docs), np.concatenate(times), len(lang))
        width = len(names[1])
        groups, at, found = np.unique(t * (len(names[0]) * width) + lang[d] * width + source[d], return_inverse=True, return_counts=True)
        total = np.bincount(at, weights=n, minlength=len(groups)).astype(np.int64)
        t, g = np.divmod(groups, len(names[0]) * width)
        what = np.stack([*np.divmod(g, width), found], axis=1)
        ends = np.searchsorted(t, np.arange(len(strings) + 1))
        out = []
        for w, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            if b > a:
                x, y = int(ends[a]), int(ends[b])
                text = b"\n".join([json.dumps(names).encode(), *[strings[i] for i in order[a:b]]])
                out.append((w, head["slice"], _squeeze(text), _squeeze(np.diff(ends[a : b + 1]).astype("<u4")), _squeeze(what[x:y].astype("<u4")), _squeeze(total[x:y].astype("<i8"))))
        return pa.Table.from_batches([_blocks(out)])

    return merge


def _added(least_docs: int):
    """lang, source, term, n of the terms of a task's buckets that ``least_docs`` documents of their language hold."""

    def run(batches):
        langs: dict[str, int] = {}
        sources: dict[str, int] = {}
        known: dict[bytes, int] = {}
        held: list[np.ndarray] = []
        rows, limit = 0, 4_000_000

        def added(parts):
            keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            sums = [np.zeros(len(keys), np.int64) for _ in range(2)]
            for k in range(2):
                np.add.at(sums[k], at, np.concatenate([p[1 + k] for p in parts]))
            return keys, *sums

        for batch in batches:
            for row in batch.to_pylist():
                head, *strings = _strings(_unsqueeze(row["text"]))
                names = json.loads(head)
                of = [np.array([d.setdefault(x, len(d)) for x in own], np.int64) for d, own in zip((langs, sources), names, strict=True)]
                ids = np.array([known.setdefault(t, len(known)) for t in strings], np.int64)
                what = _unsqueeze(row["docs"], "<u4").reshape(-1, 3).astype(np.int64)
                if len(langs) >> 11 or len(known) >> 32 or len(sources) >> 20:
                    raise ValueError("too many languages, terms of a task or sources for a key of 63 bits")
                keys = (of[0][what[:, 0]] << 52) | (np.repeat(ids, _unsqueeze(row["sizes"], "<u4")) << 20) | of[1][what[:, 1]]
                held.append((keys, _unsqueeze(row["times"], "<i8"), what[:, 2]))
                rows += len(keys)
                if rows > limit:
                    held = [added(held)]
                    rows = len(held[0][0])
                    limit = max(limit, 2 * rows)
        if not held:
            return
        keys, counts, found = added(held)
        new = np.concatenate([[True], np.diff(keys >> 20) != 0])
        run_ = np.cumsum(new) - 1
        stays = np.flatnonzero((np.bincount(run_, weights=found) >= least_docs)[run_])
        strings, names = list(known), [list(langs), list(sources)]
        for a in range(0, len(stays), 1 << 16):
            at = stays[a : a + (1 << 16)]
            own = keys[at]
            lists = [[names[0][i] for i in (own >> 52).tolist()], [names[1][i] for i in (own & ((1 << 20) - 1)).tolist()], [strings[i].decode() for i in ((own >> 20) & ((1 << 32) - 1)).tolist()]]
            yield pa.record_batch([*[pa.array(x, pa.string()) for x in lists], pa.array(counts[at])], names=["lang", "source", "term", "n"])

    return run


def term_counts(docs: DataFrame, least_docs: int = 1) -> DataFrame:
    """lang, source, term, n: occurrences of every term that ``least_docs`` documents of its language hold, over whole texts.

    A document is a row, so repeated rows and ids count each. Nulls in text, lang
    and source are empty strings. Blocks of chunks go to the chunks' buckets, where
    each distinct chunk is cut into terms once; blocks of terms go back to their
    slices, where documents are told apart; blocks of counts go to the terms'
    buckets, where they are added up. A slice, and with it any block, is of a
    bounded size, and a frequent term has one entry for each slice and source.
    """
    n = parts(docs.sparkSession)
    plain = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    chunks = store(plain.mapInArrow(tidy(_counted(n)), BLOCK), "chunks")
    terms = chunks.repartition(n, "bucket").mapInArrow(tidy(_tokenized), BLOCK)
    counts = terms.groupBy("slice").applyInArrow(_by_slice(n), BLOCK)
    return counts.repartition(n, "bucket").mapInArrow(tidy(_added(least_docs)), "lang string, source string, term string, n long")


# ----------------------------------------------------------------- comparing


def probability(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exact."""
    wide = (count + 2).cast("decimal(25,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", wide, (total + 2 * kept).cast("decimal(25,0)")) + 1


def _pairs(batches):
    """lang, i, j (places of two sources, i < j) and the sum of their divergence over the terms of a task."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        codes = langs.indices.to_numpy()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            rows = pa.array(np.flatnonzero(codes == k))
            places, p = batch.column("places").take(rows), batch.column("p").take(rows)
            none = batch.column("none").take(rows[:1]).flatten().to_numpy()
            n = len(none)
            if lang not in sums:
                sums[lang] = np.zeros((n, n), np.int64)
            table = np.repeat(none[None], len(rows), axis=0)
            table[np.repeat(np.arange(len(rows)), np.diff(places.offsets.to_numpy())), places.flatten().to_numpy()] = p.flatten().to_numpy()
            for i in range(n - 1):
                a, b = table[:, i : i + 1], table[:, i + 1 :]
                sums[lang][i, i + 1 :] += ((a - b) ** 2 // (a + b)).sum(axis=0)
    for lang, own in sums.items():
        i, j = np.triu_indices(len(own), 1)
        yield pa.record_batch([pa.array([lang] * len(i), pa.string()), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(own[i, j])], names=["lang", "i", "j", "value"])


def source_divergence(docs: DataFrame, least_docs: int = 10, terms_each: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others of its language, and by which terms from the language.

    Terms in ``least_docs`` documents of a language or more are kept. With
    p = 1 + floor(SCALE * (n + 2) / (N + 2 V)) for each kept term of a source (N:
    its occurrences of kept terms, V: kept terms of the language), q likewise of
    what it is compared with, and f = floor((p - q)^2 / (p + q)): part ``pair``
    has the sum of f for each other source, part ``term`` the ``terms_each`` terms
    used more than in the language, with their f. Ranks go by falling value, ties by item as UTF-8.

    A (lang, source) without terms takes part; a language without kept terms has
    pairs of value 0 and no terms. An empty table gives no rows. Sources of a
    language are compared in its own result's size; terms are never paired.
    """
    with scope():
        groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
        per = F.struct("source", "n")
        # as many entries as the language has sources
        terms = store(term_counts(docs, least_docs).groupBy("lang", "term").agg(F.collect_list(per).alias("own"), F.sum("n").alias("q_n")), "terms")
        totals = terms.select("lang", F.explode("own").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n"))
        whole = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("q_n").alias("q_total"))
        rows = groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
        rows = rows.join(whole, "lang", "left").select("lang", "source", "n", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("q_total", F.lit(0)).alias("q_total"))
        place = Window.partitionBy("lang").orderBy("source")
        rows = store(rows.withColumn("place", F.row_number().over(place) - 1), "sources")
        # a row for each language, with all its sources in code-point order, and what each gives a term that it doesn't use
        entry = F.array_sort(F.collect_list(F.struct("place", "source", F.when(F.col("v") > 0, probability(F.lit(0), F.col("n"), F.col("v"))).alias("p"))))
        langs = store(rows.groupBy("lang").agg(entry.alias("sources")), "languages")

        each = terms.select("lang", "term", "q_n", F.explode("own").alias("x")).select("lang", "term", "q_n", "x.source", F.col("x.n").alias("own_n")).join(rows, ["lang", "source"])
        each = each.select("lang", "source", "term", "place", probability(F.col("own_n"), F.col("n"), F.col("v")).alias("p"), probability(F.col("q_n"), F.col("q_total"), F.col("v")).alias("q"))
        used = each.groupBy("lang", "term").agg(F.collect_list("place").alias("places"), F.collect_list("p").alias("p"))
        used = used.join(langs.select("lang", F.col("sources.p").alias("none")), "lang").select("lang", "places", "p", "none")
        sums = used.mapInArrow(tidy(_pairs), "lang string, i int, j int, value long").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
        both = langs.select("lang", F.posexplode("sources.source").alias("i", "source"), F.col("sources.source").alias("others")).select("lang", "i", "source", F.posexplode("others").alias("j", "item")).where("i <> j")
        low, high = F.least("i", "j"), F.greatest("i", "j")
        pair = both.withColumns({"low": low, "high": high}).join(sums.select("lang", F.col("i").alias("low"), F.col("j").alias("high"), "value"), ["lang", "low", "high"], "left")
        pair = pair.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

        term = each.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q")).alias("value"))

        order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
        pair = pair.withColumn("rank", F.row_number().over(order))
        term = term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= terms_each)
        return keep(store(pair.unionByName(term), "divergence"))
