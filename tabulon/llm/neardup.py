"""MinHash near-duplicates of whole documents or of their paragraphs.

1. Every item becomes its set of word shingles (64-bit hashes of k lower-cased
   words; the whole sequence when it has fewer). Items with equal sets are one
   class from there on, so that thousands of copies cost one signature.
2. Universal hash minima make a signature; bands of it make buckets, one bit of
   each minimum makes the sketch by which signatures are verified. Each class
   meets the smallest class of each of its buckets (a star: linear in the
   bucket), pairs whose sketches are far below the threshold go, and the others
   are confirmed on their full sets. Later pairs are verified by a byte of each
   minimum, which tells almost as much as all of it.
3. Buckets that still hold classes without a link to each other are compared
   across these: first the best partner of each class, then, between components
   (large-star / small-star), every remaining pair, so that no link found by
   banding stays untested. Buckets of any size are dealt out in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import hash_strings, keep, mix64, odd_constants, plain_string, ragged_take, scope, slices, split_words, store, tidy, word_codes
from .components import connected_components


#: Bytes of text at once: a word takes some fifty bytes of hashes on the way to its shingles.
SLICE = 6 << 20


@dataclass(frozen=True)
class MinHashParams:
    """``bands`` x ``rows`` minima: at similarity 0.8 the chance to miss a pair is (1 - 0.8^rows)^bands, 1e-7 here."""

    shingle: int = 5
    percent: int = 80
    bands: int = 30
    rows: int = 4
    slack: float = 4.0  # standard errors below the threshold at which a pair of signatures is still confirmed on sets
    block: int = 2048  # classes of one bucket that a task holds on either side
    bloom_bits: int = 1 << 26  # at most, of the filters that keep rows out of shuffles which they would not survive
    seed: int = 7

    @property
    def size(self) -> int:
        return self.bands * self.rows

    @property
    def apart(self) -> int:
        """Bits in which two sketches may differ: a bit agrees with probability (1 + similarity) / 2."""
        agree = (1 + self.percent / 100) / 2
        return int(self.size * (1 - agree) + self.slack * (self.size * agree * (1 - agree)) ** 0.5)

    @property
    def least(self) -> int:
        """Minima in which two signatures agree at least."""
        agree = self.percent / 100
        return int(self.size * agree - self.slack * (self.size * agree * (1 - agree)) ** 0.5)


# ------------------------------------------------------------------- sets


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of words, offsets, hashes): each text's sorted set of distinct shingles."""
    offsets, flat = split_words(texts)
    index, words = word_codes(flat)
    h = hash_strings(words)[index] if len(flat) else np.zeros(0, np.uint64)
    n = np.diff(offsets)
    odd = odd_constants(k, 11)
    whole, few = np.flatnonzero(n >= k), np.flatnonzero((n > 0) & (n < k))
    raw = np.zeros(len(h), np.uint64)
    if len(h) >= k:
        m = len(h) - k + 1
        for j in range(k):
            raw[:m] += mix64(h[j : j + m] + odd[j])
    del flat, index, words
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out_offsets = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(out_offsets[-1], np.uint64)
    if len(whole):
        out[ragged_take(out_offsets[whole], count[whole])] = raw[ragged_take(offsets[whole], count[whole])]
    for i in few:
        own = h[offsets[i] : offsets[i + 1]]
        out[out_offsets[i]] = np.sum(mix64(own + odd[: len(own)])) + np.uint64(len(own))
    out = mix64(out)
    for a, b in zip(out_offsets[:-1], out_offsets[1:], strict=True):
        if b - a > 1:
            out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[out_offsets[:-1][count > 0]] = True
    sizes = np.concatenate([[0], np.cumsum(fresh)])
    return n, sizes[out_offsets], out[fresh]


def minima(offsets: np.ndarray, hashes: np.ndarray, p: MinHashParams) -> np.ndarray:
    """Signatures (uint32) of sets that are not empty."""
    a, b = odd_constants(p.size, p.seed), odd_constants(p.size, p.seed + 1)
    out = np.empty((len(offsets) - 1, p.size), np.uint32)
    step = 1 << 17  # shingles at once: they stay in the processor's cache
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + step, side="right")) - 1)
        own, starts = hashes[offsets[at] : offsets[to]], offsets[at:to] - offsets[at]
        for j in range(p.size):
            out[at:to, j] = np.minimum.reduceat((own * a[j] + b[j]) >> np.uint64(32), starts)
        at = to
    return out


def bands_and_sketch(signatures: np.ndarray, p: MinHashParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each band, a bit of each minimum in 64-bit words, a byte of each): a bucket is a hash of the band's number and minima."""
    rows = signatures.reshape(-1, p.bands, p.rows).astype(np.uint64)
    buckets = mix64(mix64((rows * odd_constants(p.rows, p.seed + 2)).sum(2)) + np.arange(p.bands, dtype=np.uint64))
    octets = (signatures * np.uint32(2654435761) >> np.uint32(24)).astype(np.uint8)
    wide = np.zeros((len(octets), -(-p.size // 64) * 64), np.uint8)
    wide[:, : p.size] = octets >> 7
    return buckets.view(np.int64), np.packbits(wide, axis=1).view(np.int64), octets


def _digests(offsets: np.ndarray, hashes: np.ndarray) -> list[bytes | None]:
    raw = memoryview(np.ascontiguousarray(hashes)).cast("B")
    return [
        hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
    ]


def paragraphs(texts: pa.Array, min_words: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, number within its text, paragraph) of every line with ``min_words`` words or more."""
    lists = pc.split_pattern(texts, "\n")
    row, flat = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists)
    first = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    number = np.arange(len(flat)) - first[row] if len(flat) else np.zeros(0, np.int64)
    long = np.flatnonzero(pc.binary_length(flat).to_numpy(zero_copy_only=False) >= 2 * min_words - 1)
    row, number, flat = row[long], number[long], flat.take(pa.array(long))
    offsets, _ = split_words(flat, lower=False)
    enough = np.flatnonzero(np.diff(offsets) >= min_words)
    return row[enough], number[enough], flat.take(pa.array(enough))


def _items(batch: pa.RecordBatch, min_words: int | None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    texts = plain_string(batch.column("text"))
    if min_words is None:
        return np.arange(len(texts)), np.zeros(len(texts), np.int64), texts
    return paragraphs(texts, min_words)


def _read_items(p: MinHashParams, min_words: int | None, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches, limit=SLICE):
            row, number, texts = _items(batch, min_words)
            n_words, offsets, hashes = shingle_sets(texts, p.shingle)
            digests = _digests(offsets, hashes)
            new = []
            for i, d in enumerate(digests):
                if d is not None and d not in seen:
                    if len(seen) < 1 << 20:  # a memo of bounded size: a class met again is only sent again
                        seen.add(d)
                    new.append(i)
            buckets: list = [None] * len(digests)
            sketches: list = [None] * len(digests)
            octets: list = [None] * len(digests)
            if new:
                at = np.array(new)
                count = np.diff(offsets)[at]
                own = hashes[ragged_take(offsets[at], count)]
                made = bands_and_sketch(minima(np.concatenate([[0], np.cumsum(count)]), own, p), p)
                for i, x, y, z in zip(new, *made, strict=True):
                    buckets[i], sketches[i], octets[i] = x.tobytes(), y, z.tobytes()
            yield pa.record_batch(
                [
                    batch.column("doc_id").take(pa.array(row)),
                    pa.array(number, pa.int64()),
                    pa.array(n_words, pa.int64()),
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(buckets, pa.binary()),
                    pa.array(sketches, pa.list_(pa.int64())),
                    pa.array(octets, pa.binary()),
                ],
                schema=schema,
            )

    return run


# ------------------------------------------------------- sets of some classes


def _numbers(column: pa.Array) -> np.ndarray:
    """64 bits of each key: a number itself, or the first bytes of a digest."""
    if pa.types.is_integer(column.type):
        return column.to_numpy().view(np.uint64)
    return np.frombuffer(b"".join([x[:8] for x in column.to_pylist()]), np.uint64)


def _bloom_positions(key: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix64(key + np.uint64(i)) % np.uint64(bits)).astype(np.int64) for i in range(3)]


def _bloom(keys: DataFrame, p: MinHashParams) -> np.ndarray:
    """A filter over the first column of a stored table, 16 bits a key, ``bloom_bits`` at most.

    It only spares a shuffle rows that will not join; when there are more keys than
    it has room for it spares fewer, and nothing else changes.
    """
    bits = 1 << min(p.bloom_bits.bit_length() - 1, max(12, (16 * keys.count()).bit_length()))

    def positions(batches):
        for b in batches:
            at = np.unique(np.concatenate(_bloom_positions(_numbers(b.column(0)), bits))) if b.num_rows else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["w", "v"])

    words = keys.select(keys.columns[0]).mapInArrow(tidy(positions), "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v"))
    out = np.zeros(bits // 64, np.int64)
    got = words.toArrow()
    out[got["w"].to_numpy()] = got["v"].to_numpy()
    return out.view(np.uint64)


@contextmanager
def _filter(keys: DataFrame, p: MinHashParams):
    """A broadcast filter over ``keys``, taken from all machines at the end: what it served has to be stored by then."""
    shared = keys.sparkSession.sparkContext.broadcast(_bloom(keys, p))
    try:
        yield shared
    finally:
        shared.destroy()


def _bloom_test(bloom: np.ndarray, key: np.ndarray) -> np.ndarray:
    hit = np.ones(len(key), bool)
    for at in _bloom_positions(key, 64 * len(bloom)):
        hit &= (bloom[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
    return hit


def _sets_of(rows: DataFrame, nodes: DataFrame, p: MinHashParams, min_words: int | None) -> DataFrame:
    """(digest, shingles) of about the classes ``nodes``, read again from the texts; a task sends a class once."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in slices(batches, limit=SLICE):
            _, _, texts = _items(batch, min_words)
            _, offsets, hashes = shingle_sets(texts, p.shingle)
            digests = _digests(offsets, hashes)
            some = [i for i, d in enumerate(digests) if d is not None and d not in seen]
            ids, blobs = [], []
            for i, h in zip(some, _bloom_test(shared.value, _numbers(pa.array([digests[i] for i in some], pa.binary()))).tolist(), strict=True):
                if h and digests[i] not in seen:
                    if len(seen) < 1 << 20:
                        seen.add(digests[i])
                    ids.append(digests[i])
                    blobs.append(hashes[offsets[i] : offsets[i + 1]].tobytes())
            yield pa.record_batch([pa.array(ids, pa.binary()), pa.array(blobs, pa.binary())], names=["digest", "shingles"])

    with _filter(nodes.select("digest"), p) as shared:
        return store(rows.select("text").mapInArrow(tidy(run), "digest binary, shingles binary"), "sets")


def _some_sets(pool: DataFrame, nodes: DataFrame, p: MinHashParams) -> DataFrame:
    """(node, shingles) of the classes ``nodes`` (node, digest) out of the ``pool``; the filter keeps others out of the shuffle."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(_bloom_test(shared.value, _numbers(b.column("digest")))))

    with _filter(nodes.select("digest"), p) as shared:
        found = pool.mapInArrow(tidy(run), pool.schema).join(nodes, "digest")
        return store(found.dropDuplicates(["node"]).select("node", "shingles"), "chosen")


def _confirm(pairs: DataFrame, sets: DataFrame, p: MinHashParams) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, on full sets."""

    def run(batches):
        for b in batches:
            good = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(x), len(y)) < p.percent * max(len(x), len(y)):
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                good[i] = 100 * shared >= p.percent * (len(both) - shared)
            yield pa.record_batch([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(good))

    x = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    y = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    return pairs.join(x, "b").join(y, "a").select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long")


# ---------------------------------------------------------------- candidates


def _buckets(classes: DataFrame, shared=None) -> DataFrame:
    """(bucket, node) for every band of every class, or about those of the buckets in a broadcast filter."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                keys = np.frombuffer(b"".join(b.column("buckets").to_pylist()), np.int64)
                node = np.repeat(b.column("node").to_numpy(), len(keys) // b.num_rows)
                if shared is not None:
                    hit = _bloom_test(shared.value, keys.view(np.uint64))
                    keys, node = keys[hit], node[hit]
                yield pa.record_batch([pa.array(keys), pa.array(node)], names=["bucket", "node"])

    return classes.select("node", "buckets").mapInArrow(tidy(run), "bucket long, node long")


def _apart(x: str, y: str, p: MinHashParams):
    """Bits in which two sketches differ."""
    words = -(-p.size // 64)
    return sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(1, words)), F.bit_count(F.col(x)[0].bitwiseXOR(F.col(y)[0])))


FEW = 8


def _across(members: DataFrame, p: MinHashParams) -> DataFrame:
    """Pairs (a, b) of different roots in one bucket whose signatures are near.

    ``members``: bucket, size, node, root, octets. Buckets over ``block`` classes
    are dealt out as pairs of blocks. In buckets of more than FEW, each class
    outside the most common root is paired with its nearest partner only, unless
    there is a column of full sets (shingles): then with one class of each other
    root that it has a confirmed link with.
    """
    exact = "shingles" in members.columns
    n = F.ceil(F.col("size") / p.block).cast("int")
    dealt = (
        members.withColumn("own", F.pmod(F.xxhash64("node"), n).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
        .select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "root", "own", "octets", *["shingles"] * exact)
    )
    sorted_ = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")

    def groups(batches):
        """Whole groups, in frames of about a million numbers."""
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            octets = np.frombuffer(b"".join(b.column("octets").to_pylist()), np.uint8).reshape(b.num_rows, p.size)
            sets = np.array(b.column("shingles").to_pylist() if exact else [None] * b.num_rows, object)
            now = [b.column(c).to_numpy() for c in ("bucket", "i", "j", "node", "root", "own")] + [octets, sets]
            now = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            same = (now[0] == now[0][-1]) & (now[1] == now[1][-1]) & (now[2] == now[2][-1])
            cut = len(same) if not same.all() else 0
            cut = int(np.flatnonzero(~same)[-1]) + 1 if cut else 0
            if cut:
                yield [x[:cut] for x in now]
            held = [x[cut:] for x in now]
        if held is not None:
            yield held

    def linked(one: bytes, others: list[bytes]) -> np.ndarray:
        """Which of the sets are near copies of the first."""
        x = np.frombuffer(one, np.uint64)
        sizes = np.array([len(o) // 8 for o in others])
        values = np.frombuffer(b"".join(others), np.uint64)
        shared = np.add.reduceat(x[np.minimum(np.searchsorted(x, values), len(x) - 1)] == values, np.cumsum(sizes) - sizes, dtype=np.int64)
        return 100 * shared >= p.percent * (len(x) + sizes - shared)

    def run(batches):
        for bucket, i, j, node, root, own, octets, sets in groups(batches):
            new = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            size = np.diff(np.concatenate([new, [len(bucket)]]))
            a, b = [], []
            for g in range(2, FEW + 1):  # small groups of one size: all their pairs at once
                first = new[size == g]
                for x in range(g):
                    for y in range(x + 1, g):
                        u, v = first + x, first + y
                        may = (root[u] != root[v]) & ((i[u] == j[u]) | (own[u] != own[v]))
                        u, v = u[may], v[may]
                        near = (octets[u] == octets[v]).sum(1) >= p.least
                        a.append(node[u[near]])
                        b.append(node[v[near]])
            for at, g in zip(new[size > FEW], size[size > FEW], strict=True):
                u = slice(at, at + g)
                roots, counts = np.unique(root[u], return_counts=True)
                for k in np.flatnonzero(root[u] != roots[np.argmax(counts)]).tolist():
                    like = (octets[u] == octets[at + k]).sum(1)
                    like[root[u] == root[at + k]] = 0
                    if i[at] != j[at]:
                        like[own[u] == own[at + k]] = 0
                    if exact:
                        hits = np.flatnonzero(like >= p.least)
                        if len(hits):
                            hits = hits[linked(sets[at + k], sets[at + hits].tolist())]
                            hits = hits[np.unique(root[at + hits], return_index=True)[1]]
                    else:
                        hits = np.array([np.argmax(like)])
                        hits = hits[like[hits] >= p.least]
                    a.append(np.full(len(hits), node[at + k]))
                    b.append(node[at + hits])
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return sorted_.mapInArrow(tidy(run), "a long, b long").distinct()


# ------------------------------------------------------------------ operator


def near_duplicates(docs: DataFrame, p: MinHashParams, min_words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, labels) for documents (``min_words`` None) or for paragraphs of ``min_words`` words or more.

    ``docs``: doc_id and text; other columns are not read. items: doc_id, part
    (line number; 0 for documents), n_words, n_shingles, digest (null without
    words). labels: digest, root: the component of every class that is linked
    with another; a digest without a row there is its own component. Null and
    empty texts have no shingles and are linked with nothing; repeated rows and
    equal sets share a digest. An empty table gives empty results.
    """
    rows = docs.select("doc_id", "text")
    schema = T.StructType(
        [
            rows.schema["doc_id"], T.StructField("part", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_shingles", T.LongType()),
            T.StructField("digest", T.BinaryType()), T.StructField("buckets", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("octets", T.BinaryType()),
        ]
    )
    pool = None

    def sets(nodes: DataFrame) -> DataFrame:
        nonlocal pool
        pool = pool if pool is not None else _sets_of(rows, nodes, p, min_words)
        return pool

    with scope():
        items = store(rows.mapInArrow(tidy(_read_items(p, min_words, to_arrow_schema(schema))), schema), "items")
        classes = items.where("buckets is not null").groupBy("digest").agg(F.first(F.struct("buckets", "sketch", "octets")).alias("x"))
        classes = store(classes.select("digest", "x.*").withColumn("node", F.monotonically_increasing_id()), "classes")
        labels = keep(link_classes(classes, sets, p))
        items = keep(store(items.drop("buckets", "sketch", "octets"), "items"))
    return items, labels


def link_classes(classes: DataFrame, sets: Callable[[DataFrame], DataFrame], p: MinHashParams) -> DataFrame:
    """digest, root: the component of every class that is linked with another.

    ``classes``: a stored table of node, digest, buckets, sketch and octets.
    ``sets``: gives (digest, shingles) of at least the classes that it is asked for
    (node, digest); it is asked once.
    """
    with scope():
        centers = _buckets(classes).groupBy("bucket").agg(F.min("node").alias("center"), F.count("*").alias("size")).where("size > 1")
        centers = store(centers, "buckets")
        with _filter(centers.select("bucket"), p) as bloom:
            members = store(_buckets(classes, bloom).join(centers, "bucket"), "members")
        sketches = classes.select(F.col("node").alias("b"), F.col("sketch").alias("y"))
        stars = members.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
        stars = stars.join(sketches, "b").join(sketches.select(F.col("b").alias("a"), F.col("y").alias("x")), "a")
        pairs = store(stars.where(_apart("x", "y", p) <= p.apart).select("a", "b"), "pairs")
        members = members.select("bucket", "size", "node")
        pool = sets(members.select("node").distinct().join(classes.select("node", "digest"), "node"))

        def confirmed(pairs: DataFrame) -> DataFrame:
            nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select("node", "digest"), "node")
            return store(_confirm(pairs, _some_sets(pool, store(nodes, "nodes"), p), p), "links")

        links = confirmed(pairs)
        # one step is enough to see which buckets are done: a class goes with its smallest confirmed center
        roots = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        for every in (False, True):
            labelled = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            open_ = labelled.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
            rest = labelled.join(open_, "bucket").drop("octets").join(classes.select("node", "octets"), "node")
            rest = store(rest, "open")
            large = rest.where(F.col("size") > FEW) if every else None
            more = store(_across(rest.where(F.col("size") <= FEW) if every else rest, p).join(pairs, ["a", "b"], "left_anti"), "pairs")
            if not more.isEmpty():
                links, pairs = links.union(confirmed(more)), pairs.union(more)
                roots = None
            if every and not large.isEmpty():
                # many near copies of each other: their sets come to the bucket, so that no pair has to leave it
                nodes = store(large.select("node").distinct().join(classes.select("node", "digest"), "node"), "nodes")
                links = links.union(store(_across(large.join(_some_sets(pool, nodes, p), "node"), p), "links"))
                roots = None
            if roots is None or not every:
                roots = connected_components(links)
            members = rest.drop("root")  # a bucket that is done stays done
        labels = roots.join(classes.select("node", "digest"), "node").select("digest", "root")
        return keep(store(labels, "labels"))


def document_components(docs: DataFrame, p: MinHashParams = MinHashParams()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept, for every row of ``docs``.

    A document without words is a component of its own. Rows with a null doc_id
    take part; the smallest id that is not null names their component.
    """
    items, labels = near_duplicates(docs, p)
    # smallest id of each class first: the copies of one text never meet in one task
    classes = items.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("low"))
    named = classes.join(labels, "digest", "left").withColumn("group", F.coalesce(F.col("root").cast("string"), F.hex("digest")))
    lows = named.groupBy("group").agg(F.min("low").alias("component_id"))
    ids = store(named.join(lows, "group").select("digest", "component_id"), "ids")
    return items.join(ids, "digest", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.when(F.col("digest").isNull(), F.lit(True)).otherwise(F.col("doc_id") == F.col("component_id")), F.lit(False)).alias("kept"),
    )


def repeated_paragraphs(docs: DataFrame, p: MinHashParams = MinHashParams(), min_words: int = 50) -> DataFrame:
    """One row for each paragraph that has a near copy: doc_id, part, n_words, component_doc_id, component_part, kept.

    A paragraph is a line of ``min_words`` words or more. The copy with the
    smallest (doc_id, part) names the component and is kept; the others are
    what a deduplicated corpus leaves out. Paragraphs without a near copy have
    no row; documents without such paragraphs have none.
    """
    items, labels = near_duplicates(docs, p, min_words)
    key = F.struct("doc_id", "part")
    classes = items.where("digest is not null").groupBy("digest").agg(F.min(key).alias("low"), F.count("*").alias("n"))
    named = classes.join(labels, "digest", "left").withColumn("group", F.coalesce(F.col("root").cast("string"), F.hex("digest")))
    lows = named.groupBy("group").agg(F.min("low").alias("first"), F.sum("n").alias("copies")).where("copies > 1")
    ids = store(named.join(lows, "group").select("digest", "first", "copies"), "ids")
    return items.join(ids, "digest").select(
        "doc_id",
        "part",
        "n_words",
        F.col("first.doc_id").alias("component_doc_id"),
        F.col("first.part").alias("component_part"),
        F.col("copies").alias("component_size"),
        (F.struct("doc_id", "part").eqNullSafe(F.col("first"))).alias("kept"),
    )
