"""Periodic runs of words: Lyndon arrays from the grouping phase of a suffix sorter, roots extended into runs.

A run is a maximal stretch of words with smallest period q. The first phase of
Baier's suffix sorter deals suffixes into groups by the longest Lyndon word that
each begins with, from the highest group down; a group that is done lengthens the
words of the positions right before its members. What it leaves is the Lyndon
array. Every run has a Lyndon root that is the longest Lyndon word at its place
under one of the two orders of the alphabet, so both orders are grouped. Two
neighbouring roots of one group are equal words; from the first of each such row
common extensions to both sides give the run.

Words that occur less than ``repeats`` times in a stretch can't lie in a run that
repeats its period so often; texts are first cut there, again and again (no run
is lost), so that only stretches that repeat themselves are grouped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain_string, slices, split_words, tidy, word_codes

#: Times that stretches are cut at rare words; more rounds only spare work.
ROUNDS = 6


def lyndon_groups(ranks: list[int]) -> tuple[list[int], list[int]]:
    """(length of the longest Lyndon word at each place, group of each place) by grouping suffixes, highest group first.

    ``ranks``: the letters as 0, 1, ... Groups are named by the place of their
    first suffix in the order so far; members of one group begin with the same
    Lyndon word, and lower groups with smaller suffixes.
    """
    n = len(ranks)
    counts = [0] * (max(ranks, default=-1) + 2)
    for c in ranks:
        counts[c + 1] += 1
    for c in range(1, len(counts)):
        counts[c] += counts[c - 1]
    group = [counts[c] for c in ranks]
    members: list[list[int] | None] = [None] * n
    size, width = [0] * n, [1] * n
    for i, g in enumerate(group):
        if members[g] is None:
            members[g] = []
        members[g].append(i)
        size[g] += 1
    lower = [-1] * n  # the nearest place before that has a lower group
    for g in range(n - 1, -1, -1):
        own = members[g]
        if own is None:
            continue
        times: dict[int, int] = {}
        for s in own:
            if group[s] != g:  # has moved up since
                continue
            p = s - 1
            while p >= 0 and group[p] > g:
                p = lower[p]
            if p >= 0 and group[p] == g:
                p = lower[p]
            lower[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if not times:
            continue
        moves: dict[tuple[int, int], list[int]] = {}
        for p, k in times.items():
            moves.setdefault((k, group[p]), []).append(p)
        for k, h in sorted(moves, reverse=True) if len(moves) > 1 else moves:
            up = moves[k, h]
            size[h] -= len(up)
            new = h + size[h]
            members[new] = up
            size[new], width[new] = len(up), width[h] + k * width[g]
            for p in up:
                group[p] = new
    return [width[g] for g in group], group


def _extent(codes: np.ndarray, i: int, q: int) -> tuple[int, int]:
    """(start, end) of the stretch around i that keeps period q: common extensions of i and i + q to both sides."""
    n, step, end = len(codes), 32, i + q
    while end < n:
        to = min(n, end + step)
        off = np.flatnonzero(codes[end:to] != codes[end - q : to - q])
        if len(off):
            end += int(off[0])
            break
        end, step = to, step * 2
    start, step = i, 32
    while start > 0:
        to = max(0, start - step)
        off = np.flatnonzero(codes[to:start] != codes[to + q : start + q])
        if len(off):
            start = to + int(off[-1]) + 1
            break
        start, step = to, step * 2
    return start, end


def runs_of(codes: np.ndarray, min_length: int, repeats: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``min_length`` and ``repeats`` >= 3 times its period, by start, then period."""
    _, ranks = np.unique(codes, return_inverse=True)
    found = set()
    for order in (ranks, ranks.max(initial=0) - ranks):
        width, group = map(np.array, lyndon_groups(order.tolist()))
        here = np.arange(len(codes))
        after, before = here + width, here - width
        twice = (after < len(codes)) & (group[np.minimum(after, len(codes) - 1)] == group)
        first = (before < 0) | (group[np.maximum(before, 0)] != group)
        for i in np.flatnonzero(twice & first).tolist():
            q = int(width[i])
            start, end = _extent(codes, i, q)
            if end - start >= max(min_length, repeats * q):
                found.add((start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(codes: np.ndarray, owner: np.ndarray, min_length: int, repeats: int) -> list[tuple[int, int]]:
    """(first, last + 1) of stretches of one owner each in which every word occurs ``repeats`` times, as far as ROUNDS cuts get."""
    place, part = np.arange(len(codes)), owner.astype(np.int64)
    for _ in range(ROUNDS):
        if not len(place):
            break
        own = codes[place]
        _, at, times = np.unique(part * (int(own.max()) + 1) + own, return_inverse=True, return_counts=True)
        stay = times[at] >= repeats
        kept, kept_part = place[stay], part[stay]
        new = np.concatenate([[True], (np.diff(kept) > 1) | (np.diff(kept_part) != 0)]) if len(kept) else np.zeros(0, bool)
        piece = np.cumsum(new) - 1
        long = np.bincount(piece)[piece] >= min_length if len(piece) else np.zeros(0, bool)
        if bool(stay.all()) and bool(long.all()):
            break
        place, part = kept[long], piece[long]
    if not len(place):
        return []
    new = np.flatnonzero(np.concatenate([[True], (np.diff(place) > 1) | (np.diff(part) != 0)]))
    ends = np.append(new[1:], len(place)) - 1
    return list(zip(place[new].tolist(), (place[ends] + 1).tolist(), strict=True))


def _digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


#: What is known of a text's runs; ``runs`` holds start, length and period of each.
SCHEMA = "n_words long, runs array<struct<start: long, length: long, period: long>>, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed string, collapsed_sha256 string"


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period, compared as fractions; ties to the smallest start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def periodic_runs(docs: DataFrame, keys: list[str], min_length: int = 24, repeats: int = 3, reorder=None, with_text: bool = False) -> DataFrame:
    """Runs of every text: the columns ``keys``, then SCHEMA (``collapsed`` only ``with_text``).

    A run has at least ``min_length`` words and ``repeats`` (3 or more) periods.
    ``collapsed`` is the text without the words that any run holds after its first
    period, joined by one space. ``reorder``: a function of a batch of keys and of
    the word offsets of its texts that gives for each word the place of the word
    that stands there instead, or None. A null or empty text has no words and no
    runs: four nulls, and digests of nothing. Rows are handled one by one, so
    repeated rows, ids and ties make no difference; a very long text is one piece
    of work of its own task. No row gives none. Other columns aren't read.
    """
    if repeats < 3:
        raise ValueError("roots are found by equal neighbours: repeats must be 3 or more")
    names = [f"k{i}" for i in range(len(keys))]
    kinds = [docs.select(F.col(f"`{k}`")).schema[0].dataType.simpleString() for k in keys]
    schema = ", ".join(f"`{k}` {t}" for k, t in zip(keys, kinds, strict=True)) + ", " + SCHEMA

    def run(batches):
        for batch in slices(batches):
            offsets, flat = split_words(plain_string(batch.column("text")), lower=False)
            if reorder is not None and len(flat):
                order = reorder([batch.column(n) for n in names], offsets)
                flat = flat.take(pa.array(order)) if order is not None else flat
            codes, _ = word_codes(flat)
            codes = codes.astype(np.int64)
            n, lengths = len(offsets) - 1, np.diff(offsets)
            runs: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
            owner = np.repeat(np.arange(n), lengths)
            for a, b in stretches(codes, owner, min_length, repeats):
                d = int(owner[a])
                runs[d] += [(a - int(offsets[d]) + s, k, q) for s, k, q in runs_of(codes[a:b], min_length, repeats)]
            gone = np.zeros(len(flat) + 1, np.int32)
            for d, own in enumerate(runs):
                for s, k, q in own:
                    gone[offsets[d] + s + q] += 1
                    gone[offsets[d] + s + k] -= 1
            stays = np.cumsum(gone[:-1]) == 0
            before = np.concatenate([[0], np.cumsum(stays)])
            left = flat if stays.all() else flat.filter(pa.array(stays))
            left = pa.ListArray.from_arrays(pa.array(before[offsets], pa.int32()), left.cast(pa.string()))
            text = pc.binary_join(left, " ")
            best = [_best(r) for r in runs]
            column = lambda f: pa.array([None if r is None else f(r) for r in best], pa.int64())
            out = [
                pa.array(lengths, pa.int64()),
                pa.array([[{"start": s, "length": k, "period": q} for s, k, q in r] for r in runs], pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))),
                pa.array([len(r) for r in runs], pa.int64()),
                *[column(lambda r, i=i: r[i]) for i in range(3)],
                column(lambda r: 1000 * r[1] // r[2]),
                pa.array([_digest("".join(f"{s},{k},{q}\n" for s, k, q in r).encode()) for r in runs]),
                text if with_text else pa.nulls(n, pa.string()),
                pa.array([_digest(x.as_buffer()) for x in text]),
            ]
            yield pa.record_batch([batch.column(x) for x in names] + out, names=[*keys, *[x.split()[0] for x in ("n_words", "runs", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed", "collapsed_sha256")]])

    return docs.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)], "text").mapInArrow(tidy(run), schema)
