"""SentencePiece BPE ids through a prefix table.

The BPE encoding of a prefix is the start of some encoding, and each prefix has
one last token. So a text needs no merge queue: an automaton names the pieces
that end at each place, the one that is compatible with the last token of the
prefix before it is that place's last token, and the ids are read off backwards.
Two tokens are compatible if merging their joined text gives just these two.
Distinct words go through it side by side, all prefixes of one length at a time;
a tree of the pieces names those in a word, for single long words an automaton.
"""

from __future__ import annotations

import hashlib
import re
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import plain_string, slices, tidy, word_codes
from .segments import assemble

#: Bytes of text that are encoded at once: smaller than elsewhere, as texts are held as pieces, words and ids side by side.
ENCODED_BYTES = 2 << 20

SPACE = "▁"
CUT = "\x1e"
PROBE = "Aé ﬁ①\u00a0  x\n\ty "  # what no normalisation may change but for spaces
NONE = -1  # last token of the empty prefix, and of one that ends in a character outside the vocabulary: nothing merges with either


class IntMap:
    """Integers by keys that are not negative, a whole array at once: open addressing, at most half full."""

    def __init__(self, bits: int):
        self.shift, self.size = np.uint64(64 - bits), 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where a key is not held."""
        slots = self._slots(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.values[slots], np.int32(-1))
        rest = np.flatnonzero((held != keys) & (held != -1))
        while len(rest):
            slots[rest] = at = slots[rest] + 1 & len(self.keys) - 1
            held = self.keys[at]
            hit = held == keys[rest]
            out[rest[hit]] = self.values[at[hit]]
            rest = rest[~hit & (held != -1)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that are not held yet. What is held goes first where it would be more than half."""
        if self.size + len(keys) > len(self.keys) // 2:
            self.keys.fill(-1)
            self.size = 0
        self.size += len(keys)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] == -1
            self.keys[slots[free]] = keys[free]
            own = self.keys[slots] == keys  # of several keys that met at a free slot one has it
            self.values[slots[own]] = values[own]
            keys, values, slots = keys[~own], values[~own], slots[~own] + 1 & len(self.keys) - 1


class PrefixTable:
    """Encoder of one BPE model with byte fallback, a space before the text and no other normalisation."""

    #: Words of more characters are encoded one by one, all others place by place, many words at once.
    LONG = 64
    #: Characters of words that are encoded at once.
    STEP = 1 << 18
    #: Pairs of tokens whose compatibility is kept: half of 2 to this power.
    PAIR_BITS = 20

    def __init__(self, path: str):
        import sentencepiece

        self.library = m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        self.bytes = {int(m.id_to_piece(i)[3:5], 16): i for i in ids if m.is_byte(i)}
        self.piece = {i: m.id_to_piece(i) for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
        self.score = {p: m.get_score(i) for i, p in self.piece.items()}
        if m.normalize(PROBE) != SPACE + PROBE.replace(" ", SPACE) or any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.piece.values()):
            raise ValueError("this model normalises texts or has pieces that reach across words: they can't be encoded piece by piece of text")
        self.lives: dict[int, tuple | None] = {}
        self.fits = IntMap(self.PAIR_BITS)
        self._grow()

    def _grow(self) -> None:
        """The tree of the pieces' characters: a node's child by node and character, and the token that ends there."""
        letters = sorted(set("".join(self.piece.values())))
        self.letter = np.zeros(0x110000, np.uint32)  # 0: in no piece
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        nodes, token, inner = {"": 0}, [-1], set()
        for i, p in self.piece.items():
            for n in range(1, len(p) + 1):
                if p[:n] not in nodes:
                    nodes[p[:n]] = len(token)
                    token.append(-1)
                    inner.add(nodes[p[: n - 1]])
            token[nodes[p]] = i
        self.ends = np.array(token, np.int32)
        self.sizes = np.array([len(self.piece.get(i, "")) for i in range(self.library.get_piece_size())], np.int32)
        self.inner = np.zeros(len(token), bool)
        self.inner[list(inner)] = True
        keys = np.array([nodes[p[:-1]] << 21 | int(self.letter[ord(p[-1])]) for p in nodes if p], np.int64)
        self.children = IntMap(2 + len(keys).bit_length())
        self.children.put(keys, np.arange(1, len(token), dtype=np.int32))  # nodes are numbered in the order of their dictionary

    @cached_property
    def automaton(self):
        found = ahocorasick.Automaton()
        for i, p in self.piece.items():
            found.add_word(p, (i, len(p)))
        found.make_automaton()
        return found

    def life(self, token: int) -> tuple | None:
        """(scores of the merges of the token's text, its first and its last part before each and at the end); None where its text gives other tokens.

        Merging takes the best score first, the leftmost of equals.
        """
        if token in self.lives:
            return self.lives[token]
        parts, scores, firsts, lasts = list(self.piece[token]), [], [], []
        while True:
            firsts.append(parts[0])
            lasts.append(parts[-1])
            best, at = None, 0
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            scores.append(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        self.lives[token] = found = (scores, firsts, lasts) if len(parts) == 1 else None
        return found

    def compatible(self, before: int, token: int) -> bool:
        """Whether ``token`` may follow ``before``: merging their joined text gives just these two.

        Until a merge reaches across the border both sides merge as they do
        alone, the better score first, the left one of equals.
        """
        if (own := self.life(token)) is None:
            return False
        if before < 0:  # none at a start: the token has only to be what its text gives
            return True
        if (first := self.life(before)) is None:
            return False
        left, right, edges, starts = first[0], own[0], first[2], own[1]
        i = j = 0
        while True:
            a, b = left[i] if i < len(left) else None, right[j] if j < len(right) else None
            across = self.score.get(edges[i] + starts[j])
            if across is not None and (a is None or across > a) and (b is None or across >= b):
                return False
            if a is None and b is None:
                return True
            if b is None or (a is not None and a >= b):
                i += 1
            else:
                j += 1

    def fit(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``compatible`` of many pairs."""
        keys = before.astype(np.int64) + 1 << 21 | token
        found = self.fits.get(keys)
        if len(new := np.flatnonzero(found < 0)):
            pairs, place = np.unique(keys[new], return_inverse=True)
            own = np.fromiter((self.compatible((k >> 21) - 1, k & 0x1FFFFF) for k in pairs.tolist()), np.int32, len(pairs))
            if len(pairs) <= len(self.fits.keys) // 2:
                self.fits.put(pairs, own)
            found[new] = own[place]
        return found > 0

    def segments(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each, ids of all) of pieces of text at whose ends nothing is merged."""
        words = words.cast(pa.large_string())
        sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, long, counts, ids, at = np.cumsum(sizes), np.append(np.flatnonzero(sizes > self.LONG), len(words)), [], [], 0
        while at < len(words):
            to = int(long[np.searchsorted(long, at)])
            if at == to:
                own = self.segment(words[at].as_py())
                counts.append(np.array([len(own)], np.int64))
                ids.append(own)
                at += 1
                continue
            to = min(to, max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + self.STEP, side="right"))))
            text = pc.binary_join(pa.ListArray.from_arrays([0, to - at], words[at:to]), pa.scalar("", pa.large_string()))[0].as_py()
            n, own = self._segments(text, sizes[at:to])
            counts.append(n)
            ids.append(own)
            at = to
        return np.concatenate([np.zeros(0, np.int64), *counts]), np.concatenate([np.zeros(0, np.int32), *ids])

    def _segments(self, text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that lie one after another in ``text``.

        Places are the borders between characters, one more in each word than it has characters.
        """
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        within = (np.arange(starts[-1]) - np.repeat(starts[:-1], sizes + 1)).astype(np.uint8)
        char = np.zeros(len(within), np.uint32)
        inside = np.ones(len(char), bool)
        inside[starts[1:] - 1] = False
        char[inside] = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        letter = self.letter[char]
        letter[~inside] = 0
        # every piece of the vocabulary in a word: the place that it begins at, its token
        at, node, begins, tokens, length = np.flatnonzero(letter), 0, [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], 0
        while len(at):
            node = self.children.get(node << 21 | letter[at + length].astype(np.int64))
            length += 1
            alive = node >= 0
            at, node = at[alive], node[alive].astype(np.int64)
            token = self.ends[node]
            full = token >= 0
            begins.append(at[full])
            tokens.append(token[full])
            alive = self.inner[node] & (letter[at + length] > 0)
            at, node = at[alive], node[alive]
        begin, token = np.concatenate(begins), np.concatenate(tokens)
        # the last token of each prefix, those of as many characters at once
        depth = within[begin] + self.sizes[token].astype(np.uint8)
        order = np.argsort(depth, kind="stable")
        begin, token = begin[order], token[order]
        end = begin + self.sizes[token]
        last = np.full(len(char), NONE, np.int32)
        cuts = np.cumsum(np.bincount(depth, minlength=1)).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            ok = self.fit(last[begin[a:b]], token[a:b])
            last[end[a:b][ok]] = token[a:b][ok]
        # back from the ends of the words
        size, taken = np.where(last == NONE, 1, self.sizes[last]), np.zeros(len(char), bool)
        at = starts[1:] - 1
        while len(at := at[within[at] > 0]):
            taken[at] = True
            at = at - size[at]
        counts, taken = np.add.reduceat(taken, starts[:-1], dtype=np.int64), np.flatnonzero(taken)
        ids = last[taken]
        if len(odd := np.flatnonzero(ids == NONE)):
            code, n_bytes = char[taken[odd] - 1], np.ones(len(ids), np.int64)
            n_bytes[odd] = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
            counts = np.diff(np.concatenate([[0], np.cumsum(n_bytes)])[np.concatenate([[0], np.cumsum(counts)])])
            ids = np.repeat(ids, n_bytes)
            ids[ids == NONE] = [self.bytes[b] for b in code.astype("<u4").tobytes().decode("utf-32-le").encode()]
        return counts, ids

    def segment(self, text: str) -> np.ndarray:
        """Ids of one such piece of text, however long."""
        n = len(text)
        last, size = [NONE] * (n + 1), [1] * (n + 1)
        fits: dict[tuple[int, int], bool] = {}
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            if last[end] != NONE:
                continue
            before = last[end - length]
            ok = fits.get((before, token))
            if ok is None:
                ok = fits[before, token] = self.compatible(before, token)
            if ok:
                last[end], size[end] = token, length
        out, at = [], n
        while at:
            if last[at] == NONE:
                out.extend(self.bytes[b] for b in reversed(text[at - 1].encode()))
            else:
                out.append(last[at])
            at -= size[at]
        return np.array(out[::-1], np.int32)

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """(offsets, segments) of texts: cut where no piece of the vocabulary reaches across.

        No piece holds a space mark after another character, and a line end is
        never part of a piece.
        """
        marked = pc.replace_substring(texts, " ", SPACE)
        odd = pc.or_(pc.or_(pc.match_substring(marked, SPACE * 2), pc.starts_with(marked, SPACE)), pc.match_substring(marked, CUT)).to_numpy(zero_copy_only=False)
        cut = pc.replace_substring(pc.replace_substring(marked, SPACE, CUT + SPACE), "\n", f"{CUT}\n{CUT}")
        first, gap = pa.scalar(SPACE, pa.large_string()), pa.scalar("", pa.large_string())
        cut = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(first, cut, gap))
        if odd.any():
            plain = marked.to_pylist()
            pieces = [re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", SPACE + plain[i]) if o else None for i, o in enumerate(odd)]
        lists = pc.split_pattern(cut, CUT)
        offsets = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        flat = pc.list_flatten(lists)
        full = pc.not_equal(pc.binary_length(flat), 0)
        if odd.any():
            full = pc.and_(full, pa.array(~np.repeat(odd, np.diff(offsets))))
        kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        flat, offsets = flat.filter(full), kept[offsets]
        if not odd.any():
            return offsets, flat
        counts = np.diff(offsets)
        counts[odd] = [len(p) for p in pieces if p is not None]
        out = np.concatenate([[0], np.cumsum(counts)])
        own = pa.array([s for p in pieces if p is not None for s in p], pa.large_string())
        is_odd = np.repeat(odd, counts)
        place = np.where(is_odd, len(flat) + np.cumsum(is_odd) - 1, np.cumsum(~is_odd) - 1)
        return out, pa.concat_arrays([flat, own]).take(pa.array(place))


def encode_texts(table: PrefixTable, texts: pa.Array, end_id: int):
    """Yield (first, last + 1, offsets, ids) for runs of texts."""
    offsets, flat = table.cut(texts)
    index, distinct = word_codes(flat)
    lengths, ids = table.segments(distinct)
    yield from assemble(offsets, index, np.cumsum(lengths) - lengths, lengths, ids, end_id)


def encode_documents(docs: DataFrame, model: str, carry: list[str] | None = None, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of every row, after the columns ``carry`` (doc_id).

    ``with_ids`` and ``with_text`` add ids and decoded. A null text is empty: it
    has the end id alone and decodes to nothing. Decoding is the library's own.
    """
    carry = carry or ["doc_id"]
    extra = ["ids"] * with_ids + ["decoded"] * with_text
    if clash := {*carry} & {"n_tokens", "ids_sha256", "decoded_sha256", *extra}:
        raise ValueError(f"columns of the input clash with those of the result: {sorted(clash)}")

    def run(batches):
        table = decimal = None
        for batch in slices(batches, "__text", ENCODED_BYTES):
            if table is None:
                table = PrefixTable(model)
                end = table.library.eos_id()
                decimal = [str(i) for i in range(table.library.get_piece_size())]
            texts = plain_string(batch.column(batch.num_columns - 1))
            for a, b, offsets, ids in encode_texts(table, texts, end):
                n, shas, decoded, back = np.diff(offsets), [], [], []
                for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    own = ids[x:y].tolist()
                    shas.append(hashlib.sha256(" ".join([decimal[i] for i in own]).encode()).hexdigest())
                    text = table.library.decode(own)
                    decoded.append(hashlib.sha256(text.encode()).hexdigest())
                    if with_text:
                        back.append(text)
                columns = [batch.column(i).slice(a, b - a) for i in range(len(carry))] + [pa.array(n), pa.array(shas), pa.array(decoded)]
                columns += [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))] * with_ids + [pa.array(back, pa.string())] * with_text
                yield pa.record_batch(columns, names=[*carry, "n_tokens", "ids_sha256", "decoded_sha256", *extra])

    fields = [docs.schema[c] for c in carry] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids + [T.StructField("decoded", T.StringType())] * with_text
    return docs.select(*carry, F.col("text").alias("__text")).mapInArrow(tidy(run), T.StructType(fields))
