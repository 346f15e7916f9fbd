"""Packing documents into sequences: best fit by partitions, certified by lower bounds, with exchange between partitions.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt to
partitions of a bounded number of rows like cards sorted by length, so that all
partitions have lengths alike, and each is packed by best-fit decreasing. Lower
bounds by dual feasible functions certify a partition whose number of sequences
can't be less. Partitions with a gap give back every sequence that has room, all
others their emptiest one, and what was given back is dealt and packed anew by
others, until a bound over all pieces is met or a round spares nothing.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, plain_string, scope, slices, store, tidy, word_codes
from .segments import assemble
from .token_files import encoder_of

#: Pieces that a partition packs, about; the last round has one partition of fewer.
ROWS = 1 << 14
#: Rounds of exchange at most. Each needs about one part in ROWS / 3 of the partitions of the one before.
ROUNDS = 8
#: Denominators of the rounding dual feasible functions.
STEPS = (1, 2, 3, 4, 5, 7, 9, 11)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that pieces need at least; ``counts[x]``: pieces of length x, 0 to ``capacity``.

    The largest bound of a family of dual feasible functions: lengths as they are;
    lengths over capacity - t as whole sequences and under t as nothing, for every
    t; and lengths rounded down to parts of k after that.
    """
    x = np.arange(capacity + 1, dtype=np.int64)
    counts = counts.astype(np.int64)
    total = counts * x
    # for t = 0 .. capacity // 2: lengths > capacity - t count whole, lengths < t count nothing
    t = np.arange(capacity // 2 + 1)
    upto = np.concatenate([[0], np.cumsum(total)])
    many = np.concatenate([[0], np.cumsum(counts)])
    whole = many[capacity + 1] - many[capacity - t + 1]
    best = int((-(-(whole * capacity + upto[capacity - t + 1] - upto[t]) // capacity)).max())
    used = np.flatnonzero(counts)
    # the functions change where a length that occurs, or its rest, is passed
    turns = np.unique(np.concatenate([[0], used + 1, capacity - used + 1]))
    turns = turns[turns <= capacity // 2]
    for k in STEPS:
        part = x * (k + 1)
        value = np.where(part % capacity == 0, part // capacity * k, part // capacity * (k + 1))  # in parts of k * (k + 1)
        weighed = np.concatenate([[0], np.cumsum(counts * value)])
        whole = many[capacity + 1] - many[capacity - turns + 1]
        sums = whole * k * (k + 1) + weighed[capacity - turns + 1] - weighed[turns]
        best = max(best, int((-(-sums // (k * (k + 1)))).max()))
    return best


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """(sequence of each piece, its place there, room left in each sequence), pieces taken in the given order.

    Each goes to the sequence with the least room that takes it; of equals to the last one touched.
    """
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some sequence has room r
    left: list[int] = []
    sequence, offset = [], []
    for n in lengths:
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            s = open_[room].pop()
            if not open_[room]:
                rooms ^= 1 << room
        else:
            room, s = capacity, len(left)
            left.append(capacity)
        sequence.append(s)
        offset.append(capacity - room)
        left[s] = room = room - n
        if room:
            open_[room].append(s)
            rooms |= 1 << room
    return sequence, offset, left


def _pieces(tokenizer: str, end_id: int, capacity: int, fold: bool):
    def run(batches):
        encoder, count, task, places = None, 0, TaskContext.get().partitionId(), Places(capacity)
        for batch in slices(batches):
            encoder = encoder or encoder_of(tokenizer, fold)
            offsets, flat = encoder.words(plain_string(batch.column("text")))
            index, words = word_codes(flat)
            starts, lengths, tokens = encoder.encode(words.to_pylist(), np.bincount(index, minlength=len(words)))
            for a, b, ends, ids in assemble(offsets, index, starts, lengths, tokens, end_id):
                ids = ids.astype("<u4")
                sizes = np.diff(ends)
                many = -(-sizes // capacity)
                doc = np.repeat(np.arange(b - a), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(capacity, sizes[doc] - start)
                at = (ends[doc] + start).tolist()
                crc = [zlib.crc32(ids[i : i + n]) for i, n in zip(at, length.tolist(), strict=True)]
                row = (task << 36) + count + np.arange(len(doc))
                count += len(doc)
                doc_id = batch.column("doc_id").slice(a, b - a).take(pa.array(doc))
                numbers = [pa.array(np.full(len(doc), task)), pa.array(places.of(length))]
                yield pa.record_batch([pa.array(row), doc_id, *map(pa.array, (piece, start, length)), pa.array(crc, pa.int64()), *numbers], names=[*PIECE, "task", "place"])

    return run


class Places:
    """Numbers the pieces of each length, one batch after another."""

    def __init__(self, capacity: int):
        self.seen = np.zeros(capacity + 1, np.int64)

    def of(self, lengths: np.ndarray) -> np.ndarray:
        order = np.argsort(lengths, kind="stable")
        own = lengths[order]
        first = np.searchsorted(own, own)
        places = np.empty(len(own), np.int64)
        places[order] = self.seen[own] + np.arange(len(own)) - first
        self.seen += np.bincount(lengths, minlength=len(self.seen))
        return places


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, fold: bool = False) -> DataFrame:
    """row (a number of its own), doc_id, piece, start, length and ids_crc32 of every piece of every text, with task and place.

    ``place`` numbers the pieces of one length that a ``task`` has made.

    A null or empty text has the end id alone. Texts are encoded word by word, so
    a very long one needs room for its own ids only. Rows of one doc_id are
    documents of their own. No row gives none.
    """
    schema = "row long, doc_id long, piece long, start long, length long, ids_crc32 long, task long, place long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(_pieces(tokenizer, end_id, capacity, fold)), schema)


def _pack(capacity: int, numbered: int):
    """Packs one partition. ``numbered``: the first sequence number of the round."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)
        lengths = rows["length"].to_numpy()
        sequence, offset, left = best_fit(lengths.tolist(), capacity)
        left = np.array(left)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        if len(left) > bound:
            back = left > 0
        else:
            back = np.zeros(len(left), bool)
            back[left.argmax()] = left.max() > 0
        rows["sequence_id"] = numbered + (int(rows["part"].iloc[0]) << 32) + np.array(sequence)
        rows["offset"] = offset
        rows["open"] = back[sequence]
        rows["first"] = rows["offset"] == 0
        rows["bound"] = bound
        rows["task"], rows["place"] = rows["part"].astype("int64"), 0
        rows.loc[rows["open"], "place"] = Places(capacity).of(lengths[rows["open"].to_numpy()])
        return rows

    return pack


def _deal(rows: DataFrame) -> DataFrame:
    """``rows`` with the partition that packs them, about ROWS to each.

    Rows sorted by length are dealt in turn. Their places in that order are sums:
    of shorter rows (one number a length), of those of tasks before (one a task
    and length), and the place in the task.
    """
    runs = rows.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    # a row for each length that occurs: at most as many as a sequence has tokens
    shorter = runs.groupBy("length").agg(F.sum("n").alias("n")).select("length", F.sum("n").over(before("length")).alias("shorter"))
    base = runs.select("length", "task", F.sum("n").over(before("length", "task")).alias("base")).join(F.broadcast(shorter), "length")
    base = base.select("length", "task", (F.coalesce("shorter", F.lit(0)) + F.coalesce("base", F.lit(0))).alias("base"))
    parts = max(1, -(-rows.count() // ROWS))
    return rows.join(base, ["length", "task"]).select(*PIECE, F.pmod(F.col("base") + F.col("place"), F.lit(parts)).cast("int").alias("part"))


PIECE = ("row", "doc_id", "piece", "start", "length", "ids_crc32")
NUMBERED = (*PIECE, "task", "place")
PLACED = "row long, doc_id long, piece long, start long, length long, ids_crc32 long, part int, sequence_id long, offset long, open boolean, first boolean, bound long, task long, place long"


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (as of ``token_pieces``; lengths 1 to ``capacity``) with sequence_id and offset, without task and place.

    Whole pieces are sequences of their own. Of a round's result all stands but
    what its partitions give back; that goes to the next round if there is one,
    else it stands too. Sequence numbers hold round, partition and sequence. The
    result doesn't change between runs over the same stored pieces. Equal lengths
    are ordered by row. No piece gives no row.
    """
    whole = pieces.where(F.col("length") == capacity).select(*PIECE, F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity).select(*NUMBERED)
    # one number for each possible length: a bounded histogram
    counts = np.zeros(capacity + 1, np.int64)
    for x, n in rest.groupBy("length").count().collect():
        counts[x] = n
    goal = lower_bound(counts, capacity)
    standing, done, before = [], 0, None
    for turn in range(ROUNDS):
        placed = _deal(rest).groupBy("part").applyInPandas(_pack(capacity, (turn + 1) << 58), PLACED)
        placed = store(placed, f"packed-{turn}")
        # the rounds' own sums: sequences that stand, sequences given back
        kept, back, parts = placed.agg(F.count_if(F.expr("first and not open")), F.count_if(F.expr("first and open")), F.max("part")).first()
        now = done + kept + back
        if before is not None and now > before:  # worse than what it was given: the round before stands
            break
        standing.append(placed)
        if now <= goal or not parts or turn == ROUNDS - 1 or now == before:
            break
        done, before = done + kept, now
        rest = placed.where("open").select(*NUMBERED)
    last = standing.pop()
    out = whole
    for t in standing:
        out = out.unionByName(t.where("not open").select(*PIECE, "sequence_id", "offset"))
    return out.unionByName(last.select(*PIECE, "sequence_id", "offset"))


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, fold: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every text; see ``token_pieces`` and ``pack``."""
    with scope():
        pieces = store(token_pieces(docs, tokenizer, end_id, capacity, fold), "pieces")
        out = keep(store(pack(pieces, capacity).drop("row"), "sequences"))
    return out
