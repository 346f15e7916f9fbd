"""Repeated passages by MinHash banding of paragraphs that the text itself marks off.

Ends of lines say little about where a copied passage begins, so the paragraphs
compared here are runs of ``unit`` words that begin at anchors: the word shingle
with the smallest hash of every ``window`` neighbours. The same words have the same
anchors wherever they stand, and ``min_words`` words in sequence always hold a whole
paragraph. Paragraphs overlap, a third of the words or so begin none.

1. Texts become chunks of word hashes, read once. Every paragraph's MinHash bands
   are sent to hash partitions, packed by chunk; keys that occur again come back.
2. Paragraphs with such a key are materialised; equal ones are a class, classes are
   linked by ``neardup.link_classes``: bands, exact Jaccard, components.
3. In each component the first place is kept. Every other place is laid beside it
   and grown in both directions word by word, over single words that differ; what
   overlaps is one stretch, and stretches of ``min_words`` words or more are found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import give_back, hash_strings, keep, mix64, odd_constants, parts, plain_string, ragged_take, scope, slices, split_words, store, tidy, word_codes
from .neardup import SLICE, MinHashParams, bands_and_sketch, link_classes

#: Words that have to agree behind a single one that differs, for a stretch to grow over it.
AGREE = 4
#: Paragraphs whose minima are taken at once.
STEP = 1 << 15


@dataclass(frozen=True)
class PassageParams:
    """Bands of two minima: of paragraphs with one anchor the chance to miss a pair at similarity 0.8 is (1 - 0.8^2)^6, 0.002.

    Band keys hold the anchor: paragraphs that begin differently never collide,
    however alike they are. A passage holds several, of which one is enough.
    """

    min_words: int = 50
    minhash: MinHashParams = field(default_factory=lambda: MinHashParams(shingle=5, bands=6, rows=2))

    @property
    def unit(self) -> int:
        return max(self.minhash.shingle, self.min_words * 2 // 5)

    @property
    def window(self) -> int:
        """Neighbouring shingles of which one is an anchor: ``min_words`` words hold this many paragraphs, and so an anchored one."""
        return self.min_words - self.unit + 1


# -------------------------------------------------------------------- paragraphs


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Smallest of the ``n`` values from each position on."""
    width = 1
    while 2 * width <= n:
        x, width = np.minimum(x[:-width], x[width:]), 2 * width
    return np.minimum(x[: len(x) - (n - width)], x[n - width :])


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position on; ``words``: 32-bit hashes."""
    m = max(0, len(words) - k + 1)
    out, odd = np.zeros(m, np.uint64), odd_constants(k, 23)
    wide = words.astype(np.uint64)
    for j in range(k):
        out += mix64(wide[j : j + m] * odd[j] + np.uint64(j))
    return mix64(out)


def anchors(shingles: np.ndarray, lengths: np.ndarray, p: PassageParams) -> np.ndarray:
    """Positions at which paragraphs begin, in texts of ``lengths`` words one after another."""
    w, k, u = p.window, p.minhash.shingle, p.unit
    if len(shingles) < w:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    least = _least(shingles, w)  # of the window from each position on
    whole = np.zeros(len(least), bool)  # windows inside one text
    count = np.maximum(lengths - (w + k - 1) + 1, 0)
    whole[ragged_take(ends - lengths, count)] = True
    least[~whole] = 0
    # a shingle is an anchor if it is the least of a window that it lies in: the greatest of their minima
    around = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    at = np.flatnonzero(~_least(~around, w) == shingles)
    text = np.searchsorted(ends, at, side="right")
    fits = at + u <= ends[text]
    at, text = at[fits], text[fits]
    if not len(at):
        return at
    # a text that repeats a few words has an anchor at each of them: one paragraph in ``unit`` words is enough
    new = np.ones(len(at), bool)
    new[1:] = (shingles[at[1:]] != shingles[at[:-1]]) | (at[1:] - at[:-1] >= u) | (text[1:] != text[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    far = (at - at[first]) // u
    new[1:] |= far[1:] != far[:-1]
    return at[new]


def signatures(shingles: np.ndarray, at: np.ndarray, p: PassageParams) -> np.ndarray:
    """Minima (uint32) of the shingles of the paragraphs that begin ``at``."""
    m, inside = p.minhash, np.arange(p.unit - p.minhash.shingle + 1)
    a, b = odd_constants(m.size, m.seed), odd_constants(m.size, m.seed + 1)
    out = np.empty((len(at), m.size), np.uint32)
    for i in range(0, len(at), STEP):
        own = shingles[at[i : i + STEP, None] + inside]
        for j in range(m.size):
            out[i : i + STEP, j] = ((own * a[j] + b[j]) >> np.uint64(32)).min(1)
    return out


def _paragraphs(words: np.ndarray, lengths: np.ndarray, p: PassageParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, where paragraphs begin, band keys of each)."""
    shingles = shingle_hashes(words, p.minhash.shingle)
    at = anchors(shingles, lengths, p)
    return shingles, at, band_keys(shingles, at, signatures(shingles, at, p), p)[0]


def band_keys(shingles: np.ndarray, at: np.ndarray, minima: np.ndarray, p: PassageParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(band keys, sketches, octets): a key holds the paragraph's anchor too, so that no paragraph collides with its neighbours in its own text."""
    if not len(at):
        return np.zeros((0, p.minhash.bands), np.int64), np.zeros((0, 1), np.int64), np.zeros((0, p.minhash.size), np.uint8)
    keys, sketches, octets = bands_and_sketch(minima, p.minhash)
    return mix64(keys.view(np.uint64) ^ shingles[at, None]).view(np.int64), sketches, octets


# ------------------------------------------------------------------------ chunks


def _chunks(p: PassageParams, schema: pa.Schema):
    """One row for some megabytes of text: ids, lengths and word hashes of the texts that can hold a passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        for batch in slices(batches, limit=SLICE):
            offsets, flat = split_words(plain_string(batch.column("text")))
            lengths = np.diff(offsets)
            some = np.flatnonzero(lengths >= p.min_words)
            if not len(some):
                continue
            index, distinct = word_codes(flat)
            used = index[ragged_take(offsets[some], lengths[some])]
            words = packed(np.maximum(mix64(hash_strings(distinct)) >> np.uint64(32), 1).astype("<u4"), used)
            ids, hashes = batch.column("doc_id").take(pa.array(some)), batch.column("text_hash").take(pa.array(some))
            one = pa.array([0, len(some)], pa.int32())
            yield pa.record_batch(
                [
                    pa.array([task << 24 | k], pa.int64()),
                    pa.ListArray.from_arrays(one, ids).cast(schema.field("ids").type),
                    pa.ListArray.from_arrays(one, hashes).cast(schema.field("hashes").type),
                    pa.array([lengths[some].astype("<i4").tobytes()], pa.binary()),
                    pa.array([words], pa.binary()),
                ],
                schema=schema,
            )
            k += 1

    return run


def packed(hashes: np.ndarray, index: np.ndarray) -> bytes:
    """Words as places in a list of their hashes, the commonest first, compressed: a third of the hashes themselves."""
    counts = np.bincount(index, minlength=len(hashes))
    order = np.argsort(-counts, kind="stable")[: int((counts > 0).sum())]
    place = np.empty(len(hashes), "<u4")
    place[order] = np.arange(len(order), dtype="<u4")
    low = place[index]
    halves = (low & 0xFFFF).astype("<u2").tobytes() + (low >> 16).astype("<u2").tobytes()
    return len(order).to_bytes(8, "little") + zstandard.ZstdCompressor(3).compress(hashes[order].tobytes() + halves)


def unpacked(data: bytes) -> np.ndarray:
    """The 32-bit hashes of all words."""
    n, raw = int.from_bytes(data[:8], "little"), zstandard.ZstdDecompressor().decompress(data[8:])
    halves = np.frombuffer(raw[4 * n :], "<u2").astype(np.uint32)
    m = len(halves) // 2
    return np.frombuffer(raw[: 4 * n], "<u4")[halves[:m] | halves[m:] << np.uint32(16)]


def _numbers(row: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(row, kind)


def _send_keys(partitions: int, p: PassageParams):
    """(part, chunk, keys): the band keys of each chunk by hash partition; a key of several paragraphs is there twice."""

    def run(batches):
        for b in batches:
            for chunk, lengths, words in zip(b.column("chunk").to_pylist(), b.column("lengths").to_pylist(), b.column("words").to_pylist(), strict=True):
                keys = _paragraphs(unpacked(words), _numbers(lengths, "<i4").astype(np.int64), p)[2]
                if not len(keys):
                    continue
                own, n = np.unique(keys, return_counts=True)
                own = np.repeat(own, np.minimum(n, 2))
                part = (own.view(np.uint64) >> np.uint64(7)) % np.uint64(partitions)
                order = np.argsort(part, kind="stable")
                bounds = np.searchsorted(part[order], np.arange(partitions + 1))
                full = np.flatnonzero(np.diff(bounds))
                own = own[order]
                yield pa.record_batch(
                    [
                        pa.array(full.astype(np.int32)),
                        pa.array(np.full(len(full), chunk)),
                        pa.array([own[bounds[i] : bounds[i + 1]].astype("<i8").tobytes() for i in full.tolist()], pa.binary()),
                    ],
                    names=["part", "chunk", "keys"],
                )

    return run


def _again(pdf: pd.DataFrame) -> pd.DataFrame:
    """What each chunk sent to a partition that was sent more than once in all."""
    rows = [_numbers(x, "<i8") for x in pdf["keys"]]
    every = np.concatenate(rows)
    order = np.argsort(every, kind="stable")
    same = every[order[1:]] == every[order[:-1]]
    again = np.zeros(len(every), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    ends = np.cumsum([len(x) for x in rows])
    found = [np.unique(x[hit]) for x, hit in zip(rows, np.split(again, ends[:-1]), strict=True)]
    some = [i for i, x in enumerate(found) if len(x)]
    del every, order, same, again
    give_back()
    return pd.DataFrame({"chunk": pdf["chunk"].to_numpy()[some], "keys": [found[i].astype("<i8").tobytes() for i in some]})


def _places(p: PassageParams, schema: pa.Schema):
    """The paragraphs of a chunk with a key that occurs again, and the words around them."""
    width = p.window - 1

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        if not chunks.num_rows or not answers.num_rows:
            return schema.empty_table()
        words, lengths = unpacked(chunks["words"][0].as_py()), _numbers(chunks["lengths"][0].as_py(), "<i4").astype(np.int64)
        wanted = np.sort(np.concatenate([_numbers(x, "<i8") for x in answers["keys"].to_pylist()]))
        shingles, at, keys = _paragraphs(words, lengths, p)
        hit = (wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys).any(1)
        at = at[hit]
        ends = np.cumsum(lengths)
        text = np.searchsorted(ends, at, side="right")
        start, end = ends[text] - lengths[text], ends[text]
        half, byte, gram = short(words, 16), short(words, 8), shingle_hashes(words, p.unit)[at]
        left = [byte[a:b].tobytes() for a, b in zip(np.maximum(start, at - width).tolist(), at.tolist(), strict=True)]
        right = [byte[a:b].tobytes() for a, b in zip((at + p.unit).tolist(), np.minimum(end, at + p.unit + width).tolist(), strict=True)]
        unit = [half[a : a + p.unit].tobytes() for a in at.tolist()]
        own = pa.array(text)
        ids, hashes = pc.list_flatten(chunks["ids"].slice(0, 1)), pc.list_flatten(chunks["hashes"].slice(0, 1))
        columns = [ids.take(own), hashes.take(own), pa.array(at - start), pa.array(gram.view(np.int64)), pa.array(unit, pa.binary()), pa.array(left, pa.binary()), pa.array(right, pa.binary())]
        del words, shingles, keys, half, byte
        give_back()
        return pa.table(columns, schema=schema)

    return run


def _sign(p: PassageParams):
    """Adds the band keys, sketch, octets and shingle set of each class."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            words = np.frombuffer(b"".join(b.column("unit").to_pylist()), "<u2")
            shingles = shingle_hashes(words, p.minhash.shingle)
            at = np.arange(b.num_rows, dtype=np.int64) * p.unit
            buckets, sketches, octets = band_keys(shingles, at, signatures(shingles, at, p), p)
            sets = shingles[at[:, None] + np.arange(p.unit - p.minhash.shingle + 1)]
            yield pa.record_batch(
                [
                    b.column("gram"),
                    pa.array([x.tobytes() for x in buckets], pa.binary()),
                    pa.array(list(sketches), pa.list_(pa.int64())),
                    pa.array([x.tobytes() for x in octets], pa.binary()),
                    pa.array([np.unique(x).tobytes() for x in sets], pa.binary()),
                ],
                names=["digest", "buckets", "sketch", "octets", "shingles"],
            )

    return run


# ------------------------------------------------------------------------ growth


def short(words: np.ndarray, bits: int) -> np.ndarray:
    """The first ``bits`` (8 or 16) of each hash, never 0: enough for a paragraph's own words, or to go on along a passage."""
    return np.maximum(words >> np.uint32(32 - bits), 1).astype(f"<u{bits // 8}")


def _laid_out(left: pa.Array, unit: pa.Array, right: pa.Array, width: int, words: int) -> np.ndarray:
    """Rows of ``width`` word hashes, a paragraph and ``width`` more; 0 where a text has no words."""
    n = len(left)
    back = np.frombuffer(b"".join([x.rjust(width, b"\0") for x in left.to_pylist()]), "u1").reshape(n, width)
    own = np.frombuffer(b"".join(unit.to_pylist()), "<u2").reshape(n, words)
    on = np.frombuffer(b"".join([x.ljust(width, b"\0") for x in right.to_pylist()]), "u1").reshape(n, width)
    return np.concatenate([back.astype("<u2"), own, on.astype("<u2")], axis=1)


def shared_run(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, words) of the longest run that two places have in common.

    A single word that differs belongs to a run if ``AGREE`` words agree on both sides of it.
    """
    n, size = x.shape
    same = (x == y) & (x != 0)
    odd = (x != y) & (x != 0) & (y != 0)
    for j in range(1, AGREE + 1):
        for a, b in ((slice(j, None), slice(None, -j)), (slice(None, -j), slice(j, None))):
            near = np.zeros_like(same)
            near[:, b] = same[:, a]
            odd &= near
    same |= odd
    run, length, end = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for j in range(size):
        run = (run + 1) * same[:, j]
        longer = run > length
        length[longer], end[longer] = run[longer], j + 1
    return end - length, length


def _grow(p: PassageParams, schema: pa.Schema):
    """The run of words that a place shares with the kept one, in both texts."""
    width = p.window - 1

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _laid_out(b.column("left"), b.column("unit"), b.column("right"), width, p.unit)
            y = _laid_out(b.column("f_left"), b.column("f_unit"), b.column("f_right"), width, p.unit)
            start, length = shared_run(x, y)
            some = pa.array(2 * length >= p.unit)
            # where a passage runs into its own copy, each word of the later one still has its like before it
            for kept, doc, text, at in ((False, "doc_id", "text_hash", "place"), (True, "f_doc_id", "f_text_hash", "f_place")):
                a = b.column(at).to_numpy() - width + start
                yield pa.record_batch([b.column(doc), b.column(text), pa.array(np.full(b.num_rows, kept)), pa.array(a), pa.array(a + length), b.column("f_doc_id")], schema=schema).filter(some)

    return run


def repeated_passages(docs: DataFrame, p: PassageParams = PassageParams()) -> DataFrame:
    """doc_id, text_hash, first_word, n_words, component_doc_id, kept: the stretches of texts that occur elsewhere too.

    Words are those of the whole text, lower-cased; ends of lines are white space
    like any other. Of a passage that occurs more than once, in different texts or
    in one, the place smallest by (doc_id, xxhash64 of the text, word) is kept, with
    null ids first; component_doc_id is the smallest doc_id that a stretch's
    paragraphs are kept in. A stretch that is not kept holds what occurs before, one
    that is kept what occurs again, and the two may overlap: whatever goes has its
    like before it. Rows equal in doc_id and text are one text;
    null and empty texts and those under ``min_words`` words have no row, and
    neither have texts without repeated passages. Texts of any length are read
    whole. Columns beside doc_id and text are not read.
    """
    spark = docs.sparkSession
    key_type = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").where("text is not null")
    long, binary = T.LongType(), T.BinaryType()
    made = lambda **fields: T.StructType([T.StructField(k, v) for k, v in fields.items()])
    schema = made(chunk=long, ids=T.ArrayType(key_type), hashes=T.ArrayType(long), lengths=binary, words=binary)
    with scope():
        chunks = store(rows.mapInArrow(tidy(_chunks(p, to_arrow_schema(schema))), schema), "chunks")
        sent = chunks.select("chunk", "lengths", "words").mapInArrow(tidy(_send_keys(parts(spark), p)), "part int, chunk long, keys binary")
        answers = sent.groupBy("part").applyInPandas(_again, "chunk long, keys binary")
        schema = made(doc_id=key_type, text_hash=long, place=long, gram=long, unit=binary, left=binary, right=binary)
        found = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_places(p, to_arrow_schema(schema)), schema)
        found = store(found, "found")

        place = F.struct("doc_id", "text_hash", "place")
        whole = F.struct("doc_id", "text_hash", "place", "left", "unit", "right")
        classes = store(found.groupBy("gram").agg(F.min(whole).alias("first"), F.max(place).alias("last")), "classes")
        signed = classes.select("gram", "first.unit").mapInArrow(tidy(_sign(p)), "digest long, buckets binary, sketch array<long>, octets binary, shingles binary")
        signed = store(signed.withColumn("node", F.monotonically_increasing_id()), "signed")
        labels = link_classes(signed.drop("shingles"), lambda _: signed.select("digest", "shingles"), p.minhash)

        named = classes.join(labels.withColumnRenamed("digest", "gram"), "gram", "left")
        named = named.withColumn("group", F.coalesce(F.concat(F.lit("r"), F.col("root").cast("string")), F.col("gram").cast("string")))
        firsts = named.groupBy("group").agg(F.min("first").alias("f"), F.max("last").alias("last"))
        firsts = firsts.where(~F.struct("f.doc_id", "f.text_hash", "f.place").eqNullSafe(F.col("last"))).drop("last")
        firsts = store(named.select("gram", "group").join(firsts, "group").select("gram", "f"), "firsts")
        held = found.join(firsts, "gram")
        same = F.struct("doc_id", "text_hash").eqNullSafe(F.struct("f.doc_id", "f.text_hash"))
        columns = ("doc_id", "text_hash", "place", "left", "unit", "right")
        held = held.where(~(same & (F.col("place") == F.col("f.place"))))
        pairs = held.select(*columns, *[F.col(f"f.{c}").alias(f"f_{c}") for c in columns])
        schema = made(doc_id=key_type, text_hash=long, kept=T.BooleanType(), a=long, b=long, source=key_type)
        spans = pairs.mapInArrow(tidy(_grow(p, to_arrow_schema(schema))), schema)
        span = F.struct("a", "b", "source")
        spans = spans.groupBy("doc_id", "text_hash", "kept").agg(F.array_sort(F.collect_set(span)).alias("s"))
        schema = made(doc_id=key_type, text_hash=long, first_word=long, n_words=long, component_doc_id=key_type, kept=T.BooleanType())
        return keep(store(spans.mapInArrow(tidy(_joined(p, to_arrow_schema(schema))), schema), "passages"))


def _joined(p: PassageParams, schema: pa.Schema):
    """Spans that overlap or touch as one stretch; those under ``min_words`` words go."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            s = batch.column("s")
            row, flat = pc.list_parent_indices(s).to_numpy(), pc.list_flatten(s)
            a, b = flat.field("a").to_numpy(), flat.field("b").to_numpy()
            base = np.int64(1) << 40
            far = np.maximum.accumulate(b + row * base) - row * base  # furthest end so far in its text
            new = np.ones(len(a), bool)
            new[1:] = (row[1:] != row[:-1]) | (a[1:] > far[:-1])
            at = np.flatnonzero(new)
            last = np.concatenate([at[1:], [len(a)]]) - 1
            n = far[last] - a[at]
            sources = pa.table({"run": np.cumsum(new) - 1, "source": flat.field("source")}).group_by("run").aggregate([("source", "min")]).sort_by("run")["source_min"].combine_chunks()
            keep = pa.array(n >= p.min_words)
            own = pa.array(row[at])
            columns = [batch.column("doc_id").take(own), batch.column("text_hash").take(own), pa.array(a[at]), pa.array(n), sources, batch.column("kept").take(own)]
            yield pa.record_batch([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=schema).filter(keep)

    return run
