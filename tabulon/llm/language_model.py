"""A hierarchical Pitman-Yor language model of words in context and of their spelling.

Each word is drawn in the restaurant of its context: the word before it, if that is
a common one, else what that word ends in. All contexts share one parent, the
restaurant of words without context; its base measure spells a word byte by byte
with a hierarchy of its own: the last byte, a class of the byte before, a class of
the one before that, each sharing its parent with all contexts that end alike, down
to no context and a uniform base. A table of a restaurant is a customer of its
parent. Gibbs sweeps take customers, chosen at random, from their tables and seat
them anew given all others; what a parent offers is that of the sweep before. The
predictive probabilities of the sweeps after the burn-in are averaged.

At scale: texts are cut into chunks. A chunk sends its distinct words, and the
contexts that each was met in, to hash partitions, which hold customers and tables,
and gets probabilities back; tokens never leave their chunk. A word is a context
of its own if it makes up a share of all training words, counted over the whole
corpus, that falls with the root of their number: contexts grow with the corpus,
but slower, and don't depend on how the table is cut. The cells of the byte
restaurants are of a fixed number. Of both only totals travel through the driver.
Words and the contexts of words grow with the corpus.

With ``own``, every other word is a context of its own too. These restaurants, the
leaves, lie in partitions by the context, so that one has all its dishes in one
place; they have less customers than a common word. In every sweep the words'
partitions send them what the parent offers and get back the tables that they have.
Most of their dishes have one customer, at one table: these are stored once and no
sweep carries them. A chunk's pairs are sent once; where they went to is kept as
numbers, and scoring brings back customers and tables, from which the chunk works
out the probabilities itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, drop_kind, forget, give_back, hash_strings, id_text, parts, plain_string, slices, split_words, store, tidy, word_codes

END = 256  # the symbol after a word's last byte, and the context before its first
SYMBOLS = 257
CLASSES = (16, 8)  # of the second and the third byte back
SHAPE = (SYMBOLS * CLASSES[0] * CLASSES[1], SYMBOLS)


#: Bytes of text in a chunk: the larger, the fewer words are sent more than once.
CHUNK_BYTES = 24 << 20

#: Training words for each partition of the model, of which there are no more than shuffle partitions: partitions send each other what they have, so that small ones only cost messages.
PARTITION_WORDS = 1 << 21


@dataclass(frozen=True)
class ModelParams:
    burn_in: int = 2
    samples: int = 3
    common: int = 2000  # a word that is one in so many training words, or in ``growth`` times the root of their number, is a context of its own
    growth: float = 0.2
    moves: int = 2  # customers of each dish that a sweep seats anew
    context_strength: float = 5.0
    word_strength: float = 10.0
    byte_strength: float = 1.0
    seed: int = 17
    own: bool = False  # words that are less common are contexts of their own too, in place of what they end in


def squeezed(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, and so on, compressed."""
    x = np.ascontiguousarray(x).ravel()
    return zstandard.ZstdCompressor(1).compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def spread(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def steps(x: np.ndarray) -> bytes:
    """Numbers that mostly rise by little, as differences."""
    return squeezed(np.diff(x, prepend=0).astype("<i4"))


def walked(data: bytes) -> np.ndarray:
    return np.cumsum(spread(data, "<i4"), dtype=np.int64)


# ----------------------------------------------------------------- seating


def seat(c: np.ndarray, a: np.ndarray, d: float, rng) -> np.ndarray:
    """Tables of ``c`` customers of one dish, seated one after another.

    ``a``: what the parent offers, (strength + discount * tables) * its probability.
    The first 64 customers are drawn one by one, later ones in runs that double.
    """
    t = np.minimum(c, 1).astype(np.int64)
    live = np.flatnonzero(c > 1)
    for i in range(1, 64):
        if not len(live):
            return t
        own, offer = t[live], a[live]
        t[live] = own + (rng.random(len(live)) * (offer + i - d * own) < offer)
        live = live[c[live] > i + 1]
    i = 64
    while len(live):
        own, offer = t[live], a[live]
        run = np.minimum(i, c[live] - i)
        rate = offer * np.log1p(run / np.maximum(offer + i - d * own, 1e-9))
        t[live] = own + np.minimum(rng.poisson(np.minimum(rate, run)), run)
        i *= 2
        live = live[c[live] > i]
    return t


def discount(ones: int, twos: int) -> float:
    return float(np.clip(ones / max(ones + 2 * twos, 1), 0.05, 0.95))


def tables_of(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Sizes of ``t`` tables for ``c`` customers of each dish to begin with: all but one of them with one customer."""
    sizes = np.ones(int(t.sum()), np.int64)
    some = t > 0
    sizes[np.cumsum(t[some]) - t[some]] = c[some] - t[some] + 1
    return sizes


class Tables:
    """Tables of many dishes side by side, with room for new ones; every call moves one customer of each dish asked for."""

    def __init__(self, sizes: np.ndarray, t: np.ndarray, room: int):
        self.t, self.width = t.copy(), t + room
        self.start = np.cumsum(self.width) - self.width
        self.slots = np.zeros(int(self.width.sum()), np.int64)
        at = np.repeat(self.start, t) + np.arange(len(sizes)) - np.repeat(np.cumsum(t) - t, t)
        self.slots[at] = sizes
        self.free = self.start + t
        self.c = np.add.reduceat(np.append(self.slots, 0), self.start) * (self.width > 0) if len(t) else np.zeros(0, np.int64)

    def leave(self, dishes: np.ndarray, rng) -> None:
        """A customer of each dish, any with the same chance, leaves; an empty table goes."""
        ends = np.cumsum(self.slots)
        before = ends[self.start[dishes]] - self.slots[self.start[dishes]]
        k = np.searchsorted(ends, before + (rng.random(len(dishes)) * self.c[dishes]).astype(np.int64), side="right")
        self.slots[k] -= 1
        self.c[dishes] -= 1
        self.t[dishes] -= self.slots[k] == 0

    def come(self, dishes: np.ndarray, offer: np.ndarray, d: float, rng) -> None:
        """A customer of each dish sits down: at a table by its size less ``d``, at a new one by ``offer``."""
        old = np.maximum(self.c[dishes] - d * self.t[dishes], 0)
        new = rng.random(len(dishes)) * (old + offer[dishes]) < offer[dishes]
        new |= self.t[dishes] == 0
        fresh, joins = dishes[new], dishes[~new]
        self.slots[self.free[fresh]] = 1
        self.free[fresh] += 1
        self.t[fresh] += 1
        if len(joins):
            ends = np.cumsum(self.slots - d * (self.slots > 0))
            before = ends[self.start[joins]] - np.where(self.slots[self.start[joins]] > 0, self.slots[self.start[joins]] - d, 0)
            k = np.searchsorted(ends, before + rng.random(len(joins)) * old[~new], side="right")
            k = np.clip(k, self.start[joins], self.free[joins] - 1)
            while (empty := self.slots[k] == 0).any():  # at the edge of rounding: the table before, round the dish
                k[empty] = np.where(k[empty] > self.start[joins][empty], k[empty] - 1, self.free[joins][empty] - 1)
            self.slots[k] += 1
        self.c[dishes] += 1

    def sizes(self) -> np.ndarray:
        return self.slots[self.slots > 0]


def reseat(sizes: np.ndarray, t: np.ndarray, offer: np.ndarray, d: float, moves: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, tables) after ``moves`` customers of each dish with two customers or more left and came back, one after another."""
    tables = Tables(sizes, t, moves)
    some = np.flatnonzero(tables.c > 1)
    for _ in range(moves if len(some) else 0):
        tables.leave(some, rng)
        tables.come(some, offer, d, rng)
    return tables.sizes(), tables.t


def settle(sizes: np.ndarray, t: np.ndarray, wanted: np.ndarray, offer: np.ndarray, d: float, rng) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, tables) once each dish has the ``wanted`` customers: those too many leave, those missing come."""
    have = np.zeros(len(t), np.int64)
    np.add.at(have, np.repeat(np.arange(len(t)), t), sizes)
    tables = Tables(sizes, t, np.maximum(wanted - have, 0))
    while len(many := np.flatnonzero(tables.c > wanted)):
        tables.leave(many, rng)
    while len(few := np.flatnonzero(tables.c < wanted)):
        tables.come(few, offer, d, rng)
    return tables.sizes(), tables.t


# ------------------------------------------------------- spelling restaurants


def _class(byte: np.ndarray, n: int) -> np.ndarray:
    return (byte.astype(np.uint32) * np.uint32(2654435761) >> np.uint32(20)) % np.uint32(n)


def letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of symbols of each word with its end, cell of each symbol): cell = deepest context * SYMBOLS + symbol."""
    n = len(words)
    raw = words.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + n + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if raw.buffers()[2] else np.zeros(0, np.uint8)
    sizes = np.diff(offsets) + 1
    ends = np.cumsum(sizes)
    symbol = np.full(int(ends[-1]) if n else 0, END, np.int64)
    inside = np.ones(len(symbol), bool)
    inside[ends - 1] = False
    symbol[inside] = data
    # three symbols back; before a word's first byte stands END, as after the last one of the word before
    back = []
    place = np.arange(len(symbol)) - np.repeat(ends - sizes, sizes)
    for k in (1, 2, 3):
        own = np.full(len(symbol), END, np.int64)
        own[k:] = symbol[:-k] if k else symbol
        own[place < k] = END
        back.append(own)
    context = (back[0] * CLASSES[0] + _class(back[1], CLASSES[0])) * CLASSES[1] + _class(back[2], CLASSES[1])
    return sizes, context * SYMBOLS + symbol


class Spelling:
    """The byte restaurants: levels of 257 * 16 * 8, 257 * 16, 257 and 1 contexts."""

    def __init__(self, p: ModelParams):
        self.p = p
        self.sizes = (SHAPE[0], SHAPE[0] // CLASSES[1], SYMBOLS, 1)
        self.levels: list[np.ndarray] | None = None
        self.seen: list[np.ndarray] = []

    def sample(self, cells: np.ndarray, counts: np.ndarray, rng) -> None:
        """Seat the customers (cell, count) anew, bottom up, then set the predictive table, top down."""
        parents = self.levels
        seated = []
        c = np.zeros(SHAPE, np.int64)
        c.ravel()[cells] = counts
        for level, size in enumerate(self.sizes):
            at = np.flatnonzero(c.ravel())
            own = c.ravel()[at]
            d = discount(int((own == 1).sum()), int((own == 2).sum()))
            t = np.minimum(own, 1)
            if parents is not None:
                context, symbol = at // SYMBOLS, at % SYMBOLS
                up = parents[level + 1][context // (size // self.sizes[level + 1]) if level + 1 < len(self.sizes) else 0, symbol]
                tables = np.bincount(context, t, size)
                t = seat(own, (self.p.byte_strength + d * tables[context]) * up, d, rng)
            seated.append((c, at, t, d))
            if level + 1 < len(self.sizes):
                ratio = size // self.sizes[level + 1]
                c = np.bincount(at // SYMBOLS // ratio * SYMBOLS + at % SYMBOLS, t, self.sizes[level + 1] * SYMBOLS).astype(np.int64).reshape(-1, SYMBOLS)
        predictive = [np.full((1, SYMBOLS), 1 / SYMBOLS)]
        for level in range(len(self.sizes) - 1, -1, -1):
            c, at, t, d = seated[level]
            size = self.sizes[level]
            up = np.repeat(predictive[-1], size // len(predictive[-1]), axis=0)
            customers, tables = c.sum(1, keepdims=True), np.bincount(at // SYMBOLS, t, size)[:, None]
            own = c.astype(np.float64)
            own.ravel()[at] -= d * t
            predictive.append((own + (self.p.byte_strength + d * tables) * up) / (self.p.byte_strength + customers))
        self.levels = predictive[::-1]
        self.seen = [c.any(1) for c, *_ in seated]

    def compact(self) -> tuple[np.ndarray, np.ndarray]:
        """(row of each deepest context, rows of predictive probabilities): a context without customers has its nearest ancestor's."""
        index, context, rows, n = np.full(SHAPE[0], -1), np.arange(SHAPE[0]), [], 0
        for level, size in enumerate(self.sizes):
            seen = self.seen[level]
            at = n + np.cumsum(seen) - 1
            index = np.where((index < 0) & seen[context], at[context], index)
            rows.append(self.levels[level][seen])
            n += int(seen.sum())
            context = context // (size // self.sizes[level + 1]) if level + 1 < len(self.sizes) else context
        rows.append(np.full((1, SYMBOLS), 1 / SYMBOLS))
        return np.where(index < 0, n, index).astype(np.int32), np.concatenate(rows).astype(np.float32)


# ------------------------------------------------------------------ contexts


def _counted(share: int, only: list[str] | None = None):
    """word, n, cut of each chunk's words that make up at least one in ``share`` of it, or of the words ``only``.

    cut: how often a word that is left out may be there. A null word has the chunk's number of words.
    """

    def run(batches):
        for batch in slices(batches, limit=CHUNK_BYTES):
            _, flat = split_words(plain_string(batch.column("text")))
            index, words = word_codes(flat)
            n, cut = np.bincount(index, minlength=len(words)), (len(index) - 1) // share
            if only is None:
                some = np.flatnonzero(n > cut)
            else:
                some = np.flatnonzero(pc.is_in(words, pa.array(only, words.type)).to_numpy(zero_copy_only=False))
            names = pa.concat_arrays([words.take(pa.array(some)).cast(pa.string()), pa.nulls(1, pa.string())])
            yield pa.record_batch([names, pa.array(np.append(n[some], len(index))), pa.array(np.full(len(some) + 1, max(cut, 0)))], names=["word", "n", "cut"])

    return run


@dataclass
class Contexts:
    """Number of each context: of words by name, the end (an empty word) first; of others by their last byte."""

    words: dict[str, int]
    tokens: int = 0  # training words

    @property
    def n(self) -> int:
        return len(self.words) + 256

    def of(self, words: list[str], own_only: bool = False) -> np.ndarray:
        """With ``own_only``, ``n`` for all but the words that have a number."""
        own, n = self.words, self.n
        if own_only:
            return np.array([own.get(w, n) for w in words], np.int64)
        return np.array([own[w] if w in own else len(own) + w.encode()[-1] for w in words], np.int64)


def contexts(rows: DataFrame, p: ModelParams) -> Contexts:
    """The contexts that the training rows (text) call for: exact counts over all of them, however they are cut into chunks.

    Chunks send the counts of words far rarer than asked for; what the others can
    add at most is known. Words between both bounds, if any, are counted again.
    At most ``common`` or ``growth`` times the root of the number of words come back.
    """
    spread_ = 64 * p.common
    while True:
        sent = store(rows.mapInArrow(tidy(_counted(spread_)), "word string, n long, cut long"), "common")
        n, left_out = sent.where("word is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("cut"), F.lit(0))).first()
        need = -(-n // max(p.common, round(p.growth * n**0.5)))
        if left_out < max(need, 1):  # no word that no chunk sends can be common
            break
        spread_ *= 8
        drop(sent)
    per = sent.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"), F.sum("cut").alias("cut"))
    per = per.where(F.col("n") + left_out - F.col("cut") >= max(need, 1)).select("word", "n")
    found = {r.word: r.n for r in per.collect()}
    drop(sent)
    unsure = sorted(w for w, k in found.items() if k < need)
    if unsure:
        again = rows.mapInArrow(tidy(_counted(spread_, unsure)), "word string, n long, cut long").where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
        found |= {r.word: r.n for r in again.collect()}
    return Contexts({w: i for i, w in enumerate(["", *sorted(w for w, k in found.items() if k >= need)])}, int(n))


def context_kind(n: int) -> str:
    """How the numbers of ``n`` contexts are written."""
    return "<u2" if n < 1 << 16 else "<u4"


# ------------------------------------------------------------------- chunks


def _keys(tokens: np.ndarray, of: np.ndarray, n_contexts: int) -> tuple[np.ndarray, int]:
    """(a number for each token's pair of word and context, the first that is a leaf's).

    Common contexts' pairs go by word, then context; leaves' ones by context, then word.
    """
    before, top = np.roll(tokens, 1), len(of) * n_contexts  # before a chunk's first document stands the end of its last
    number = of[before]
    return np.where(number < n_contexts, tokens * n_contexts + number, top + before * len(of) + tokens), top


def _part(hashes: np.ndarray, partitions: int) -> np.ndarray:
    """The partition of each hash; rises with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(partitions) >> np.uint64(32)).astype(np.int64)


def _chunks(partitions: int, shared, own: bool = False):
    """Rows of kind stream (a chunk's tokens as numbers of its words) and of kind word (its distinct words and pairs, by partition).

    With ``own``, pairs whose context is no common word follow in rows of kind leaf, by the partition of the context.
    Words are numbered by their hashes, so that all chunks and partitions have them in the same order.
    """

    def one(batch, chunk):  # of its own, so that nothing of a chunk is held while the next one is read
        known = shared.value
        kind = context_kind(known.n)
        held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        offsets, flat = split_words(plain_string(batch.column("text")))
        index, words = word_codes(flat)
        lengths, n = np.diff(offsets), len(words)  # n: number of the end, which every document has
        names = np.array([*words.to_pylist(), ""], object)
        hashes = pd.util.hash_array(names, categorize=False)
        order = np.argsort(hashes, kind="stable")
        names, part = names[order].tolist(), _part(hashes[order], partitions)
        rank = np.empty(n + 1, np.int64)
        rank[order] = np.arange(n + 1)
        tokens = rank[np.insert(index, offsets[1:], n)]  # each document, then its end
        of = known.of(names, own)
        key, top = _keys(tokens, of, known.n)
        key = np.sort(key << 1 | np.repeat(~held, lengths + 1))
        ends = np.append(np.flatnonzero(np.diff(key >> 1)) + 1, len(key))
        pairs, counts = key[ends - 1] >> 1, np.diff(np.cumsum(key & 1)[ends - 1], prepend=0).astype("<i4")
        del key
        bounds = np.searchsorted(part, np.arange(partitions + 1))
        rows = [q for q in range(partitions) if bounds[q + 1] > bounds[q]]
        shared_pairs = int(np.searchsorted(pairs, top))
        word, context = np.divmod(pairs[:shared_pairs], known.n)
        after, follower = np.divmod(pairs[shared_pairs:] - top, n + 1)
        at = np.searchsorted(word, bounds)
        cut = [(slice(bounds[q], bounds[q + 1]), slice(at[q], at[q + 1])) for q in rows]
        m, none = len(rows), [None]
        doc_ids = pa.array([batch.column("doc_id").to_pylist()], pa.list_(batch.column("doc_id").type))
        yield pa.record_batch(
            [
                pa.array(["stream"] + ["word"] * m),
                pa.array([chunk] * (m + 1)),
                pa.array([-1, *rows], pa.int32()),
                pa.array(none + [_joined_names(names[w]) for w, _ in cut], pa.binary()),
                pa.array([squeezed(tokens.astype("<i4"))] + [squeezed((word[x] - w.start).astype("<i4")) for w, x in cut], pa.binary()),
                pa.array([squeezed(held.astype("u1"))] + [squeezed(counts[x]) for _, x in cut], pa.binary()),
                pa.array([squeezed(of.astype(kind))] + [squeezed(context[x].astype(kind)) for _, x in cut], pa.binary()),
                pa.array([len(pairs)] + [int(x.start) for _, x in cut], pa.int64()),
                pa.array([n + 1] + [int(w.start) for w, _ in cut], pa.int64()),
                pa.concat_arrays([doc_ids, pa.nulls(m, doc_ids.type)]),
                pa.array([squeezed(lengths.astype("<i4")), *none * m], pa.binary()),
            ],
            names=CHUNK,
        )
        first = np.flatnonzero(np.diff(after, prepend=-1))  # where each context's pairs begin
        theirs, sizes = after[first], np.diff(np.append(first, len(after)))
        ends, at = np.searchsorted(after, bounds), np.searchsorted(theirs, bounds)
        rows = [q for q in rows if ends[q + 1] > ends[q]]
        m = len(rows)
        cut = [(slice(ends[q], ends[q + 1]), slice(shared_pairs + ends[q], shared_pairs + ends[q + 1]), slice(at[q], at[q + 1])) for q in rows]
        ours = [np.unique(follower[x], return_inverse=True) for x, _, _ in cut]
        yield pa.record_batch(
            [
                pa.array(["leaf"] * m, pa.string()),
                pa.array([chunk] * m, pa.int64()),
                pa.array(rows, pa.int32()),
                pa.array([_joined_names([names[i] for i in ws]) for ws, _ in ours], pa.binary()),
                pa.array([squeezed(i.astype("<i4")) for _, i in ours], pa.binary()),
                pa.array([squeezed(counts[y]) for _, y, _ in cut], pa.binary()),
                pa.array([squeezed(sizes[z].astype("<i4")) for _, _, z in cut], pa.binary()),
                pa.array([y.start for _, y, _ in cut], pa.int64()),
                pa.array([z.start for _, _, z in cut], pa.int64()),
                pa.nulls(m, doc_ids.type),
                pa.array([_joined_names([names[i] for i in theirs[z]]) for _, _, z in cut], pa.binary()),
            ],
            names=CHUNK,
        )

    def run(batches):
        task = TaskContext.get().partitionId()
        for k, batch in enumerate(slices(batches, limit=CHUNK_BYTES)):
            yield from one(batch, task << 24 | k)

    return run


#: Of a stream row: words of the tokens, held-out flags, each word's number as a context. Of a word row: words, each pair's word, customers and context. Of a leaf row: words, each pair's word and customers, pairs of each context, names of the contexts (lengths). first, word: where the row's pairs and its words (contexts) begin; of a stream how many there are.
CHUNK = ["kind", "chunk", "part", "words", "pairs", "counts", "contexts", "first", "word", "doc_ids", "lengths"]

STATE = (
    "part int, words binary, n binary, pos binary, context binary, c binary, t binary, sizes binary, wt binary, wsizes binary, sums binary, probs binary, "
    "cells binary, spelled binary, tables binary, tokens long, types long, ones long, twos long, wtokens long, wtables long, wones long, wtwos long, mass double, leaf binary, fixed binary, asks array<struct<part:int,x:binary>>"
)
#: Of each chunk the words (at), its pairs (pairs) and which of these training has (seen), as numbers of the partition.
ASKED = "kind string, part int, chunk long, first long, word long, at binary, pairs binary, seen binary"


def _names(data: bytes) -> list[str]:
    return zstandard.ZstdDecompressor().decompress(data).decode().split(" ")


def _joined_names(names: list[str]) -> bytes:
    return zstandard.ZstdCompressor(1).compress(" ".join(names).encode())


def _coded(lists) -> tuple[pa.Array, np.ndarray, list[np.ndarray]]:
    """(distinct names in order of their hashes, hashes, the number of each name of each list)."""
    lists = [pc.split_pattern(pa.array([zstandard.ZstdDecompressor().decompress(x).decode()], pa.large_string()), " ").flatten() for x in lists]
    code = pa.concat_arrays(lists).dictionary_encode()
    by_name = pc.sort_indices(code.dictionary).to_numpy()  # the order of rows in a group is not fixed
    hashes = hash_strings(code.dictionary)
    order = by_name[np.argsort(hashes[by_name], kind="stable")]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    every, ends = rank[code.indices.to_numpy()], np.cumsum([0, *map(len, lists)])
    return code.dictionary.take(pa.array(order)), hashes[order], [every[a:b] for a, b in zip(ends, ends[1:])]


def _counted_pairs(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[tuple[bytes, bytes]]]:
    """(keys that training has, customers, for each list its numbers among these and which it has): one before stands for a key that training has not."""
    pairs, which = np.unique(np.concatenate(keys), return_inverse=True)
    c = np.bincount(which, np.concatenate(counts), len(pairs)).astype(np.int64)
    number, ends = np.cumsum(c > 0) - 1, np.cumsum([0, *map(len, keys)])
    found = [(steps(number[which[a:b]]), np.packbits(c[which[a:b]] > 0).tobytes()) for a, b in zip(ends, ends[1:])]
    return pairs[c > 0], c[c > 0], found


def _looked_up(pairs: bytes, seen: bytes, *values: np.ndarray) -> list[np.ndarray]:
    """Values of the pairs that a chunk asks for, 0 where training has none."""
    at = walked(pairs)
    has = np.unpackbits(np.frombuffer(seen, np.uint8), count=len(at)).astype(bool)
    return [np.where(has, np.append(x, 0)[at], 0).astype("<i4") for x in values]


def _columns(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    names = _columns(schema)
    return pd.DataFrame([[r.get(x) for x in names] for r in rows], columns=names, dtype=object)


def _merge(n_contexts: int):
    """All chunks' words and pairs of one partition: customers, and one table for each dish to begin with.

    ``asked``: of each partition of leaves the words that it has, and the customers and tables that these have there.
    """

    def run(pdf: pd.DataFrame, asked: pd.DataFrame | None = None) -> pd.DataFrame:
        distinct, _, codes = _coded(pdf["words"])
        words, part = distinct.to_pylist(), int(pdf["part"].iloc[0])
        keys = [code[spread(x, "<i4")] * n_contexts + spread(y, context_kind(n_contexts)) for code, x, y in zip(codes, pdf["pairs"], pdf["contexts"])]
        pairs, c, found = _counted_pairs(keys, [spread(x, "<i4") for x in pdf["counts"]])
        pos, context = pairs // n_contexts, pairs % n_contexts
        n = np.bincount(pos, c, len(words)).astype(np.int64)
        t = np.ones(len(c), np.int64)
        leaf, fixed, asks, names = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], pd.Index(words)
        for ask in asked.itertuples(index=False) if asked is not None else ():
            at = names.get_indexer(_names(ask.words))
            n[at] += spread(ask.n, "<i4")
            leaf[at] += spread(ask.t, "<i4")
            fixed[at] += spread(ask.base, "<i4")
            if len(live := walked(ask.pos)):
                asks.append({"part": int(ask.sender), "x": squeezed(at[live].astype("<i4"))})
        customers = np.bincount(pos, minlength=len(words)) + leaf
        wt = np.minimum(customers, 1)
        out = _state(part, words, n, pos, context, c, t, c.copy(), wt, customers[customers > 0], np.zeros(len(c)), np.zeros((0, len(words))), 0.0, n_contexts, leaf, fixed, asks)
        rows = [{"kind": "asked", "part": part, "chunk": int(k), "first": int(a), "word": int(b), "at": steps(code), "pairs": x, "seen": y} for k, a, b, code, (x, y) in zip(pdf["chunk"], pdf["first"], pdf["word"], codes, found)]
        out = _frame([{"kind": "state", **out.iloc[0].to_dict()}, *rows], MERGED)
        give_back()
        return out

    return run


MERGED = ASKED + STATE.removeprefix("part int")


def _state(part, words, n, pos, context, c, t, sizes, wt, wsizes, sums, probs, mass, n_contexts, leaf, fixed, asks) -> pd.DataFrame:
    """A partition: ``n`` tokens of each word, its pairs with customers and tables, the words' own tables, and what the samples have added up: their tables (sums)."""
    some = np.flatnonzero(wt)
    lengths, cell = letters(pa.array(np.asarray(words, dtype=object)[some], pa.large_string()))
    spelled = np.bincount(cell, np.repeat(wt[some], lengths))
    cells = np.flatnonzero(spelled)
    spelled = spelled[cells].astype("<i8")
    customers = np.bincount(pos, t, len(words)).astype(np.int64) + leaf
    of_context = np.bincount(context, t, n_contexts).astype("<i8")
    return pd.DataFrame(
        {
            "part": [part], "words": [zstandard.ZstdCompressor(1).compress(" ".join(words).encode())], "n": [squeezed(n.astype("<i8"))], "pos": [squeezed(pos.astype("<i4"))], "context": [squeezed(context.astype(context_kind(n_contexts)))],
            "c": [squeezed(c.astype("<i8"))], "t": [squeezed(t.astype("<i4"))], "sizes": [squeezed(sizes.astype("<i8"))], "wt": [squeezed(wt.astype("<i8"))], "wsizes": [squeezed(wsizes.astype("<i8"))],
            "sums": [squeezed(sums.astype("<i4"))], "probs": [squeezed(probs.astype("<f8"))], "cells": [cells.astype("<i4").tobytes()], "spelled": [spelled.tobytes()], "tables": [squeezed(of_context)],
            "tokens": [int(n.sum())], "types": [int((n > 0).sum())], "ones": [int((c == 1).sum())], "twos": [int((c == 2).sum())],
            "wtokens": [int(customers.sum())], "wtables": [int(wt.sum())], "wones": [int((customers == 1).sum())], "wtwos": [int((customers == 2).sum())], "mass": [mass], "leaf": [squeezed(leaf.astype("<i8"))], "fixed": [squeezed(fixed.astype("<i4"))], "asks": [asks],
        }
    )


def _word_base(words, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Probability of each word's spelling."""
    index, rows = table
    sizes, cell = letters(pa.array(np.asarray(words, dtype=object), pa.large_string()))
    if not len(sizes):
        return np.zeros(0)
    logs = np.log(rows[index[cell // SYMBOLS], cell % SYMBOLS].astype(np.float64))
    return np.exp(np.add.reduceat(logs, np.cumsum(sizes) - sizes))


def _cells(state: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Customers of the byte restaurants: a row for each cell, of which there is a fixed number.

    Few tasks add up what many partitions of words have, so that each sends a cell once.
    """

    def added(cells: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        every, where = np.unique(np.concatenate(cells), return_inverse=True)
        return every, np.bincount(where, np.concatenate(n), len(every)).astype(np.int64)

    def rows(batches):
        cells, n, held = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cells.append(np.frombuffer(x, "<i4"))
                n.append(np.frombuffer(y, "<i8"))
                held += len(cells[-1])
                if held > 1 << 22:
                    one, sums = added(cells, n)
                    cells, n, held = [one], [sums], len(one)
        one, sums = added(cells, n)
        yield pa.record_batch([pa.array(one, pa.int32()), pa.array(sums)], names=["cell", "n"])

    few = state.select("cells", "spelled").coalesce(max(1, parts(state.sparkSession) // 8))
    got = few.mapInArrow(tidy(rows), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow().sort_by("cell")
    return got["cell"].to_numpy(), got["n"].to_numpy()


@dataclass
class Fitted:
    """The seated restaurants; ``state`` has words and pairs by partition with what the samples add up to, ``contexts`` what each context leaves to its parent."""

    state: DataFrame
    leaves: DataFrame | None  # the contexts that are no common words, by partition of the context
    live: DataFrame | None  # what of these the sweeps move, and has been added up
    asked: DataFrame  # what each chunk wants to know of the words' partitions,
    asked_leaves: DataFrame | None  # and of the leaves', with the customers that these have
    chunks: DataFrame
    samples: int
    tokens: int
    types: int
    customers: np.ndarray  # of each context, with its strength
    left: np.ndarray  # (samples, contexts): what it offers its parent
    unknown: np.ndarray  # (samples,): what the words' restaurant leaves to words not seen
    strength: float
    discounts: tuple[float, float]  # of common contexts and of the leaves


def fit(docs: DataFrame, held_out: Column, p: ModelParams = ModelParams()) -> Fitted:
    """Learn from the rows whose ``held_out`` is false; every row's tokens are kept for scoring.

    Texts are lower-cased (A-Z) words and one end each; null texts are empty.
    Repeated rows are learned from as often as they are there. How the table is
    cut into files and partitions changes what is drawn by chance, and nothing else.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    known = contexts(rows.where("not held_out").select("text"), p)
    shared = spark.sparkContext.broadcast(known)
    kinds = [T.StringType(), T.LongType(), T.IntegerType(), *[T.BinaryType()] * 4, T.LongType(), T.LongType(), T.ArrayType(docs.schema["doc_id"].dataType), T.BinaryType()]
    schema = T.StructType([T.StructField(c, k) for c, k in zip(CHUNK, kinds, strict=True)])
    partitions = min(parts(spark), max(spark.sparkContext.defaultParallelism, -(-known.tokens // PARTITION_WORDS)))
    chunks = store(rows.mapInArrow(tidy(_chunks(partitions, shared, p.own)), schema), "chunks", "kind")
    shared.destroy()  # the chunks are written
    words = chunks.where("kind = 'word'").select("part", "chunk", "first", "word", "words", "pairs", "counts", "contexts")
    leaves = live = None
    d1 = d2 = 0.0
    if p.own:
        given = chunks.where("kind = 'leaf'").select("part", "chunk", "first", "word", "words", "pairs", "counts", "contexts", "lengths")
        leaves = store(given.groupBy("part").applyInPandas(_merge_leaves(partitions), LEAVES), "leaves", "kind")
        drop_kind(chunks, "leaf")
        asked = leaves.where("kind = 'up'").select("part", "sender", "words", "n", "t", "base", "pos")
        merged = store(words.groupBy("part").cogroup(asked.groupBy("part")).applyInPandas(_merge(known.n), MERGED), "words", "kind")
        drop_kind(leaves, "up")
        live = leaves.where("kind = 'live'").select(*_columns(LIVE))
        d2 = discount(*live.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("ones", "twos")]).first())
    else:
        merge = _merge(known.n)
        merged = store(words.groupBy("part").applyInPandas(lambda pdf: merge(pdf), MERGED), "words", "kind")  # of two arguments the first would be the key
    drop_kind(chunks, "word")
    state = merged.where("kind = 'state'").select(*_columns(STATE))
    del words
    forget(spark)
    spelling, rng = Spelling(p), np.random.default_rng(p.seed)
    names = ("tokens", "types", "ones", "twos", "wtokens", "wtables", "wones", "wtwos")
    tokens = types = 0
    customers, left, unknown = np.zeros(known.n), [], []
    for sweep in range(p.burn_in + p.samples + 1):
        sums = state.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
        tokens, types = sums["tokens"], sums["types"]
        if not tokens:
            break
        spelling.sample(*_cells(state), rng)
        if not sweep:
            customers = _by_context(state, known.n, "c")
        tables = _by_context(state, known.n, "t")
        d1, d0 = discount(sums["ones"], sums["twos"]), discount(sums["wones"], sums["wtwos"])
        keep, last = sweep > p.burn_in, sweep == p.burn_in + p.samples
        offer0 = p.word_strength + d0 * sums["wtables"]
        now = spark.sparkContext.broadcast((spelling.compact(), p.context_strength + d1 * tables))
        was, move = [state, live], _sweep(now, d1, d0, offer0, sums["wtokens"], sweep, keep, last, known.n, p)
        carried = state.drop("cells", "spelled", "tables")
        if p.own:
            down = state.select("part", "words", "n", "pos", "t", "wt", "leaf", "asks").mapInArrow(tidy(_offers(now, d0, offer0, sums["wtokens"], p)), "part int, sender int, x binary")
            live = store(live.drop("up").groupBy("part").cogroup(down.groupBy("part")).applyInPandas(_sweep_leaves(d2, sweep, keep, last, p), LIVE), "leaves")
            up = live.select(F.col("part").alias("sender"), F.explode("up").alias("u")).select("u.part", "sender", "u.x")
            state = store(carried.groupBy("part").cogroup(up.groupBy("part")).applyInPandas(move, STATE), "sweep")
            del down, up
        else:
            state = store(carried.mapInPandas(tidy(lambda frames: (move(pdf) for pdf in frames)), STATE), "sweep")
        if sweep:
            drop(*[x for x in was if x is not None])
        else:
            drop_kind(merged, "state")
            if p.own:
                drop_kind(leaves, "live")
        del was, carried
        forget(spark)
        now.destroy()  # the sweep is written
        if keep:
            mass = state.agg(F.sum("mass")).first()[0]
            left.append(p.context_strength + d1 * tables)
            unknown.append(offer0 / (p.word_strength + sums["wtokens"]) * (1 - mass))
    asked = merged.where("kind = 'asked'").select(*_columns(ASKED))
    asked_leaves = leaves.where("kind in ('asked', 'kept')").select(*_columns(ASKED), "context", "c") if p.own else None
    if p.own:
        kept = leaves.where("kind = 'kept'").select("part", "words", "contexts", "pos", "context", "c")
        leaves = kept.groupBy("part").cogroup(live.select("part", "t").groupBy("part")).applyInPandas(_restaurants, "part int, words binary, contexts binary, pos binary, context binary, c binary, t binary")
    return Fitted(state, leaves, live, asked, asked_leaves, chunks, p.samples, tokens, types, customers + p.context_strength, np.array(left).reshape(-1, known.n), np.array(unknown), p.context_strength, (d1, d2))


def _by_context(state: DataFrame, n: int, what: str) -> np.ndarray:
    """Customers (c) or tables (t) of every context; few tasks add up what many partitions have."""

    def run(batches):
        out = np.zeros(n, np.int64)
        for b in batches:
            for i in range(b.num_rows):
                out += spread(b.column(1)[i].as_py(), "<i8") if what == "t" else np.bincount(spread(b.column(0)[i].as_py(), context_kind(n)), spread(b.column(1)[i].as_py(), "<i8"), n).astype(np.int64)
        some = np.flatnonzero(out)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(out[some])], names=["context", "n"])

    few = state.select("context", "tables" if what == "t" else "c").coalesce(max(1, parts(state.sparkSession) // 8))
    got = few.mapInArrow(tidy(run), "context int, n long").groupBy("context").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n)
    out[got["context"].to_numpy()] = got["n"].to_numpy()
    return out


def _sweep(now, d1: float, d0: float, offer0: float, wtokens: int, sweep: int, keep: bool, last: bool, n_contexts: int, p: ModelParams):
    """Add the probabilities of the state as it stands, if it counts, then move customers: of the contexts' restaurants, then of the words'."""

    def run(pdf: pd.DataFrame, up: pd.DataFrame | None = None) -> pd.DataFrame:
        table, left = now.value
        out = []
        for row in pdf.itertuples(index=False):
            words, n, pos, context = _names(row.words), spread(row.n, "<i8"), spread(row.pos, "<i4").astype(np.int64), spread(row.context, context_kind(n_contexts)).astype(np.int64)
            c, t, sizes, wt, wsizes = spread(row.c, "<i8"), spread(row.t, "<i4").astype(np.int64), spread(row.sizes, "<i8"), spread(row.wt, "<i8"), spread(row.wsizes, "<i8")
            sums, probs, leaf, fixed = spread(row.sums, "<i4"), spread(row.probs, "<f8").reshape(-1, len(words)), spread(row.leaf, "<i8"), spread(row.fixed, "<i4")
            base = _word_base(words, table)
            customers = np.bincount(pos, t, len(words)) + leaf
            prob = (customers - d0 * wt + offer0 * base) / (p.word_strength + wtokens)
            if keep:
                sums, probs = sums + t, np.concatenate([probs, prob[None].astype(np.float32)])
            if not last:
                if up is not None:  # the tables that the leaves have now
                    asks, leaf = {x["part"]: x["x"] for x in row.asks}, fixed.astype(np.int64)
                    for x in up.itertuples(index=False):
                        leaf[spread(asks[x.sender], "<i4")] += spread(x.x, "<i4")
                rng = np.random.default_rng((p.seed, sweep, row.part))
                if not sweep:  # all are seated one after another to begin with
                    t = seat(c, left[context] * prob[pos], d1, rng)
                    wanted = np.bincount(pos, t, len(words)).astype(np.int64) + leaf
                    wt = seat(wanted, offer0 * base, d0, rng)
                    sizes, wsizes = tables_of(c, t), tables_of(wanted, wt)
                else:
                    sizes, t = reseat(sizes, t, left[context] * prob[pos], d1, p.moves, rng)
                    wanted = np.bincount(pos, t, len(words)).astype(np.int64) + leaf
                    wsizes, wt = settle(wsizes, wt, wanted, offer0 * base, d0, rng)
                    wsizes, wt = reseat(wsizes, wt, offer0 * base, d0, p.moves, rng)
            out.append(_state(row.part, words, n, pos, context, c, t, sizes, wt, wsizes, sums, probs, float(base[n > 0].sum()), n_contexts, leaf, fixed, list(row.asks)))
        give_back()
        return pd.concat(out) if out else pdf

    return run


# -------------------------------------------------------------------- leaves

#: What may still change of a partition's leaves: dishes of several customers (pos: among the words that have such ones, which begin for each partition of words at ``at``), and of the contexts that have some (ctxs) the dishes of one customer (base) and all tables at each sample.
LIVE = "part int, at binary, pos binary, context binary, ctxs binary, base binary, c binary, t binary, sizes binary, sums binary, tables binary, up array<struct<part:int,x:binary>>, ones long, twos long"
LEAVES = ASKED + ", sender int, words binary, contexts binary, n binary" + LIVE.removeprefix("part int, at binary")


def _merge_leaves(partitions: int):
    """All chunks' pairs of one partition of contexts, in rows of several kinds.

    kept: names, and all pairs with their customers. live: see ``LIVE``. asked: what each chunk asks for. up: to each
    partition of words those that are here, their customers and tables, the tables of dishes of one customer, and
    which of them have other ones.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part, (words, hashes, word), (contexts, _, met) = int(pdf["part"].iloc[0]), _coded(pdf["words"]), _coded(pdf["lengths"])
        keys = [np.repeat(x, spread(k, "<i4")) * len(words) + w[spread(i, "<i4")] for x, k, w, i in zip(met, pdf["contexts"], word, pdf["pairs"])]
        pairs, c, found = _counted_pairs(keys, [spread(x, "<i4") for x in pdf["counts"]])
        del keys
        pos, context = pairs % len(words), pairs // len(words)
        rows = [{"kind": "asked", "chunk": int(k), "first": int(a), "word": int(b), "at": steps(code), "pairs": x, "seen": y} for k, a, b, code, (x, y) in zip(pdf["chunk"], pdf["first"], pdf["word"], met, found)]
        names = words.to_pylist()
        rows.append({"kind": "kept", "words": _joined_names(names), "contexts": _joined_names(contexts.to_pylist()), "pos": squeezed(pos.astype("<i4")), "context": steps(context), "c": squeezed(c.astype("<i4"))})
        of, live = _part(hashes, partitions), c > 1
        ours, mine = np.unique(pos[live], return_inverse=True)
        ctxs, theirs = np.unique(context[live], return_inverse=True)
        base, at, mc = np.bincount(context[~live], minlength=len(contexts))[ctxs], np.searchsorted(of[ours], np.arange(partitions + 1)), c[live]
        none = np.zeros(0)
        state = _live_state(part, at, mine, theirs, ctxs, base, mc, np.ones(len(mc), np.int64), mc, np.zeros(len(mc)), none, int((c == 1).sum()), int((c == 2).sum()))
        rows.append({"kind": "live", **state.iloc[0].to_dict()})
        n, t, fixed = (np.bincount(pos[x], y, len(words)).astype("<i4") for x, y in ((slice(None), c), (slice(None), None), (~live, None)))
        bounds = np.searchsorted(of, np.arange(partitions + 1))
        for q in np.flatnonzero(np.diff(bounds)):
            own = slice(bounds[q], bounds[q + 1])
            rows.append({"kind": "up", "part": int(q), "sender": part, "words": _joined_names(names[own]), "n": squeezed(n[own]), "t": squeezed(t[own]), "base": squeezed(fixed[own]), "pos": steps(ours[at[q] : at[q + 1]] - own.start)})
        out = _frame([{"part": part} | x for x in rows], LEAVES)
        give_back()
        return out

    return run


def _live_state(part, at, pos, context, ctxs, base, c, t, sizes, sums, tables, ones, twos) -> pd.DataFrame:
    seated = np.bincount(pos, t, int(at[-1])).astype("<i4")
    up = [{"part": int(q), "x": squeezed(seated[at[q] : at[q + 1]])} for q in np.flatnonzero(np.diff(at))]
    return pd.DataFrame(
        {
            "part": [part], "at": [steps(at)], "pos": [squeezed(pos.astype("<i4"))], "context": [steps(context)], "ctxs": [steps(ctxs)], "base": [squeezed(base.astype("<i4"))],
            "c": [squeezed(c.astype("<i4"))], "t": [squeezed(t.astype("<i4"))], "sizes": [squeezed(sizes.astype("<i4"))], "sums": [squeezed(sums.astype("<i4"))], "tables": [squeezed(tables.astype("<i4"))],
            "up": [up], "ones": [ones], "twos": [twos],
        }
    )


def _restaurants(kept: pd.DataFrame, live: pd.DataFrame) -> pd.DataFrame:
    """A partition of leaves with the tables of all dishes."""
    out = kept[["part", "words", "contexts", "pos", "context", "c"]].reset_index(drop=True)
    c = spread(out["c"].iloc[0], "<i4")
    t = np.ones(len(c), "<i4")
    t[c > 1] = spread(live["t"].iloc[0], "<i4")
    return out.assign(t=[squeezed(t)])


def _offers(now, d0: float, offer0: float, wtokens: int, p: ModelParams):
    """To each partition of leaves the probabilities without context of the words that it asks for."""

    def run(batches):
        table, _ = now.value
        for batch in batches:
            for row in batch.to_pylist():
                n, asks = spread(row["n"], "<i8"), [spread(ask["x"], "<i4") for ask in row["asks"]]
                wanted = np.zeros(len(n), bool)
                for at in asks:
                    wanted[at] = True
                some, prob = np.flatnonzero(wanted), np.zeros(len(n), "<f4")
                customers = np.bincount(spread(row["pos"], "<i4"), spread(row["t"], "<i4"), len(n)) + spread(row["leaf"], "<i8")
                base = _word_base(np.array(_names(row["words"]), object)[some], table)
                prob[some] = (customers[some] - d0 * spread(row["wt"], "<i8")[some] + offer0 * base) / (p.word_strength + wtokens)
                for ask, at in zip(row["asks"], asks, strict=True):
                    yield pa.record_batch([pa.array([ask["part"]], pa.int32()), pa.array([row["part"]], pa.int32()), pa.array([squeezed(prob[at])], pa.binary())], names=["part", "sender", "x"])

    return run


def _sweep_leaves(d: float, sweep: int, keep: bool, last: bool, p: ModelParams):
    """As ``_sweep``, for the restaurants of a partition of leaves: all of a context's dishes are in it.

    A dish of one customer has one table, whatever is drawn, so that only the others are here.
    """

    def run(pdf: pd.DataFrame, down: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        at, context, ctxs = (walked(row[x]) for x in ("at", "context", "ctxs"))
        pos, base, c, t, sizes, sums, tables = (spread(row[x], "<i4").astype(np.int64) for x in ("pos", "base", "c", "t", "sizes", "sums", "tables"))
        prob = np.zeros(int(at[-1]), "<f4")
        for x in down.itertuples(index=False):
            prob[at[x.sender] : at[x.sender + 1]] = spread(x.x, "<f4")
        now = base + np.bincount(context, t, len(base)).astype(np.int64)
        if keep:
            sums, tables = sums + t, np.concatenate([tables, now])
        if not last:
            offer, rng = (p.context_strength + d * now)[context] * prob[pos], np.random.default_rng((p.seed, sweep, int(row["part"]), 1))
            if not sweep:
                t = seat(c, offer, d, rng)
                sizes = tables_of(c, t)
            else:
                sizes, t = reseat(sizes, t, offer, d, p.moves, rng)
        out = _live_state(int(row["part"]), at, pos, context, ctxs, base, c, t, sizes, sums, tables, int(row["ones"]), int(row["twos"]))
        give_back()
        return out

    return run


def score(model: Fitted) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row that ``fit`` saw.

    base_score: add-one unigram. Both scores are log10 of the text's probability, its
    end included, over the same events: the training words, and one event for all
    others, which gets what the model leaves in that context to words not seen.
    A word after an unknown one is drawn in the context of what that one ends in.
    Without training tokens the only event is the unknown one, and scores are 0.
    Texts are scored whole, whatever their length; repeated rows are scored each.
    """
    id_type = model.chunks.schema["doc_ids"].dataType.elementType
    n, v, samples = model.tokens, model.types, model.samples
    given, left, unknown, strength, (d1, d2) = model.customers, model.left, model.unknown, model.strength, model.discounts
    names = ["leaf", "chunk", "first", "word", "n", "x", "c", "t"]  # of words: customers and probabilities; of leaves: customers and tables; of both: customers and tables of pairs

    def answer(asked: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        row, out = state.iloc[0], []
        tokens, c, sums = spread(row["n"], "<i8"), spread(row["c"], "<i8"), spread(row["sums"], "<i4")
        probs = np.where(tokens > 0, spread(row["probs"], "<f8").reshape(-1, len(tokens)), 0).astype("<f4")
        for ask in asked.itertuples(index=False):
            at = walked(ask.at)
            out.append((False, ask.chunk, ask.first, ask.word, squeezed(tokens[at]), squeezed(probs[:, at]), *map(squeezed, _looked_up(ask.pairs, ask.seen, c, sums))))
        give_back()
        return pd.DataFrame(out, columns=names)

    def answer_leaves(asked: pd.DataFrame, live: pd.DataFrame) -> pd.DataFrame:
        kept, row, out = asked[asked["kind"] == "kept"].iloc[0], live.iloc[0], []
        asked = asked[asked["kind"] == "asked"]
        c, context, ctxs = spread(kept["c"], "<i4"), walked(kept["context"]), walked(row["ctxs"])
        sums = np.full(len(c), samples, np.int64)
        sums[c > 1] = spread(row["sums"], "<i4")
        met = [walked(x) for x in asked["at"]]
        size = 1 + max(int(x.max()) for x in met)
        customers, tables = np.bincount(context, c, size).astype("<i8"), np.tile(np.bincount(context, minlength=size), (samples if n else 0, 1))
        tables[:, ctxs] = spread(row["tables"], "<i4").reshape(len(tables), len(ctxs))
        for at, ask in zip(met, asked.itertuples(index=False), strict=True):
            out.append((True, ask.chunk, ask.first, ask.word, squeezed(customers[at]), squeezed(tables[:, at].astype("<i4")), *map(squeezed, _looked_up(ask.pairs, ask.seen, c, sums))))
        give_back()
        return pd.DataFrame(out, columns=names)

    schema = "leaf boolean, chunk long, first long, word long, n binary, x binary, c binary, t binary"
    answers = model.asked.groupBy("part").cogroup(model.state.select("part", "n", "c", "sums", "probs").groupBy("part")).applyInPandas(answer, schema)
    if model.asked_leaves is not None:
        answers = answers.union(model.asked_leaves.groupBy("part").cogroup(model.live.select("part", "ctxs", "sums", "tables").groupBy("part")).applyInPandas(answer_leaves, schema))
    streams = model.chunks.where("kind = 'stream'").select("chunk", "pairs", "counts", "contexts", "first", "word", "doc_ids", "lengths")
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]

    def documents(stream: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in stream.itertuples(index=False):
            tokens, of = spread(row.pairs, "<i4").astype(np.int64), spread(row.contexts, context_kind(len(given))).astype(np.int64)
            key, top = _keys(tokens, of, len(given))
            pairs, which = np.unique(key, return_inverse=True)
            common = int(np.searchsorted(pairs, top))
            word, context = np.divmod(pairs[:common], len(given))
            after, follower = np.divmod(pairs[common:] - top, row.word)
            leaf = np.cumsum(np.diff(after, prepend=-1) > 0) - 1
            word, leaves, some = np.concatenate([word, follower]), int(leaf[-1]) + 1 if len(leaf) else 0, len(left)
            count, prob, seated, tables = np.zeros(row.word, np.int64), np.zeros((some, row.word)), np.zeros(leaves, np.int64), np.zeros((some, leaves))
            customers, own = np.zeros((2, row.first))
            for a in answers.itertuples(index=False):
                x = spread(a.n, "<i8")
                at, (of_all, per) = slice(a.word, a.word + len(x)), (seated, tables) if a.leaf else (count, prob)
                of_all[at], per[:, at] = x, spread(a.x, "<i4" if a.leaf else "<f4").reshape(some, len(x))
                x = spread(a.c, "<i4")
                customers[a.first : a.first + len(x)], own[a.first : a.first + len(x)] = x, spread(a.t, "<i4")
            log = np.zeros(len(pairs))
            if n:
                total = some * customers
                total[:common] -= d1 * own[:common]
                total[common:] -= d2 * own[common:]
                for k in range(some):
                    offer = np.concatenate([left[k][context], (strength + d2 * tables[k])[leaf]])
                    total += offer * np.where(count > 0, prob[k], unknown[k])[word]
                log = np.log10(np.maximum(total / some / np.concatenate([given[context], (strength + seated)[leaf]]), 1e-300))
            lengths = spread(row.lengths, "<i4").astype(np.int64) + 1
            c = count[tokens]
            starts = np.cumsum(lengths) - lengths
            sums = [np.add.reduceat(x, starts) for x in ((c > 0).astype(np.int64), np.log10((c + 1) / (n + v + 1)), log[which])]
            ids = pd.Series(list(row.doc_ids), dtype=object)
            values = [ids.where(ids.notna(), None), spread(row.counts, "u1").astype(bool), lengths, sums[0], n, sums[1], sums[2], 10 ** (-sums[2] / lengths)]
            out.append(pd.DataFrame(dict(zip(columns, values, strict=True))))
        give_back()
        return pd.concat(out) if out else pd.DataFrame(columns=columns)

    kinds = [id_type, T.BooleanType(), *[T.LongType()] * 3, *[T.DoubleType()] * 3]
    schema = T.StructType([T.StructField(c, k) for c, k in zip(columns, kinds, strict=True)])
    return streams.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(documents, schema)


def every_seventh(column: str = "doc_id") -> Column:
    """The documents that the model never learns from."""
    return F.crc32(id_text(column).cast("binary")) % 7 == 2
