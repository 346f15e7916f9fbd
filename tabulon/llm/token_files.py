"""Token ids of a corpus as flat unsigned integer files with 64-bit document offsets.

A shard is three files: ``.bin`` (the ids, little-endian, 16 bits where the
vocabulary allows it, else 32), ``.idx`` (64-bit offsets of the documents in the
shard, one more than documents) and ``.doc`` (64-bit document ids). Shards
follow doc_id; a shard's place in the whole stream is the sum of the ids before
it. A file's name holds its task attempt, and only the attempt whose row Spark
commits is listed, so that a repeated task does no harm.
"""

from __future__ import annotations

import os
import uuid
import zlib
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import open_fs, parts, plain_string, ragged_take, scratch, slices, split_words, store, tidy, word_codes
from .segments import assemble


class WordEncoder:
    """Ids of words by the tokenizers library, for a tokenizer that drops white space and never joins across it.

    ``fold``: it also lower-cases texts and cuts letters from marks, so that case
    and a word's last comma or full stop can be taken off before distinct words
    are sought. Words that a slice has more than once are remembered, up to
    MEMO of them, from task to task of a worker.
    """

    MARK = "\x01"
    MEMO = 400_000

    def __init__(self, path: str, fold: bool, at_once: int = 256):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.fold = fold
        self.at_once = at_once
        self._check()
        mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.known: dict[str, int] = {}
        self.known_lengths: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.known_ids: list[np.ndarray] = [np.zeros(0, np.uint32)]

    def _check(self) -> None:
        """Raise if this tokenizer does not do what cutting texts into words takes for granted."""
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        whole, parts_ = "Ab cD1\n\tEf, gh.\n x-Y", ["Ab", "cD1", "Ef,", "gh.", "x-Y"]
        if ids(whole) != [i for w in parts_ for i in ids(w)]:
            raise ValueError("this tokenizer keeps white space or joins across it: its texts can't be encoded word by word")
        if self.fold and ids(whole) != [i for w in ("ab", "cd1", "ef", ",", "gh", ".", "x-y") for i in ids(w)]:
            raise ValueError("this tokenizer tells upper from lower case or joins marks to letters: use fold=False")

    def words(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """(offsets, words) of texts."""
        if self.fold:
            plain = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z0-9])([.,])([ \n])", r"\1 \2\3")
            texts = pc.if_else(pc.match_substring(texts, "<|"), texts, plain)  # may hold a special token, which has a case
        return split_words(texts, lower=False)

    def encode(self, words: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start and number of each word's ids, ids)."""
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        fresh = [words[i] for i in new.tolist()]
        lengths, ids = self._encode(fresh)
        old_lengths, old_ids = np.concatenate(self.known_lengths), np.concatenate(self.known_ids)
        self.known_lengths, self.known_ids = [old_lengths], [old_ids]
        at[new] = len(old_lengths) + np.arange(len(new))
        every = np.concatenate([old_lengths, lengths])
        starts = np.cumsum(every) - every
        often = np.flatnonzero(counts[new] > 1)[: max(0, self.MEMO - len(self.known))]
        if len(often):
            self.known.update(zip([fresh[i] for i in often.tolist()], range(len(old_lengths), len(old_lengths) + len(often)), strict=True))
            first = np.cumsum(lengths) - lengths
            self.known_lengths.append(lengths[often])
            self.known_ids.append(ids[ragged_take(first[often], lengths[often])])
        return starts[at], every[at], np.concatenate([old_ids, ids])

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids). Words travel in groups, with a mark of its own id between them."""
        odd = [i for i, w in enumerate(words) if self.mark is None or self.MARK in w]
        plain = words if not odd else [w for w in words if self.mark is not None and self.MARK not in w]
        gap = f" {self.MARK} "
        groups = [gap.join(plain[i : i + self.at_once]) + gap for i in range(0, len(plain), self.at_once)]
        flat = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)]
        flat = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        marks = np.flatnonzero(flat == self.mark) if self.mark is not None else np.zeros(0, np.int64)
        lengths = np.diff(marks, prepend=-1) - 1
        flat = np.delete(flat, marks)
        if not odd:
            return lengths, flat
        own = [self.tokenizer.encode(words[i], add_special_tokens=False).ids for i in odd]
        every = np.zeros(len(words), np.int64)
        is_odd = np.zeros(len(words), bool)
        is_odd[odd] = True
        every[~is_odd], every[is_odd] = lengths, [len(x) for x in own]
        out = np.zeros(int(every.sum()), np.uint32)
        place = np.repeat(is_odd, every)
        out[~place], out[place] = flat, np.array([y for x in own for y in x], np.uint32)
        return every, out


@lru_cache(maxsize=2)
def encoder_of(path: str, fold: bool) -> WordEncoder:
    """One encoder for all tasks of a Python worker."""
    return WordEncoder(path, fold)


def _write(folder: str, tokenizer: str, end_id: int, fold: bool):
    def run(batches):
        shard = TaskContext.get().partitionId()
        fs, base = open_fs(f"{folder}/{shard:06d}-{uuid.uuid4().hex}")
        encoder, n_docs, n_ids, nulls, out = None, 0, 0, 0, {}
        for batch in slices(batches):
            if encoder is None:
                encoder = encoder_of(tokenizer, fold)
                kind = np.dtype("<u2" if max(encoder.vocabulary, end_id + 1) <= 1 << 16 else "<u4")
                fs.create_dir(base.rpartition("/")[0], recursive=True)
                out = {x: fs.open_output_stream(f"{base}.{x}") for x in ("bin", "idx", "doc")}
                out["idx"].write(np.zeros(1, "<i8").tobytes())
            ids = batch.column("doc_id")
            nulls += ids.null_count
            out["doc"].write(pc.fill_null(ids, 0).cast(pa.int64()).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            offsets, flat = encoder.words(plain_string(batch.column("text")))
            index, words = word_codes(flat)
            starts, lengths, tokens = encoder.encode(words.to_pylist(), np.bincount(index, minlength=len(words)))
            for _, _, ends, part in assemble(offsets, index, starts, lengths, tokens.astype(kind), end_id):
                out["bin"].write(part.astype(kind).tobytes())
                out["idx"].write((ends[1:] + n_ids).astype("<i8").tobytes())
                n_ids += len(part)
            n_docs += batch.num_rows
        for x in out.values():
            x.close()
        if n_docs:
            yield pa.record_batch(
                [pa.array([shard], pa.int32()), pa.array([f"{folder}/{base.rpartition('/')[2]}"]), pa.array([kind.str[1:]]), pa.array([n_docs]), pa.array([n_ids]), pa.array([nulls])],
                names=["shard", "path", "kind", "n_docs", "n_ids", "nulls"],
            )

    return run


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, fold: bool = False) -> DataFrame:
    """Write the ids of every text in ascending doc_id order; return the shards with their place in the stream.

    Shards: shard, path (without suffix), kind, n_docs, n_ids, nulls, base (ids
    of all shards before). Null doc_ids come first; a null text is empty and has
    the end id alone. An empty table gives no shards. Rows of one doc_id follow
    each other in the order of their texts.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(parts(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    shards = store(ordered.mapInArrow(tidy(_write(folder, tokenizer, end_id, fold)), "shard int, path string, kind string, n_docs long, n_ids long, nulls long"), "shards")
    # one row for each task that wrote: a prefix sum of a few numbers
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return store(shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "bases")


def _buffer(path: str):
    fs, at = open_fs(path)
    if fs.type_name == "local":
        return pa.memory_map(at).read_buffer()
    with fs.open_input_file(at) as f:
        return f.read_buffer(f.size())


def read_token_files(shards: DataFrame, with_ids: bool = False, at_once: int = 1 << 14) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit integers) and, on demand, ids of every document."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(_buffer(f"{row['path']}.bin"), f"<{row['kind']}")
                offsets = np.frombuffer(_buffer(f"{row['path']}.idx"), "<i8")
                doc_ids = np.frombuffer(_buffer(f"{row['path']}.doc"), "<i8")
                if len(ids) != row["n_ids"] or len(doc_ids) != row["n_docs"]:
                    raise ValueError(f"{row['path']} is not whole")
                for a in range(0, row["n_docs"], at_once):
                    b = min(a + at_once, row["n_docs"])
                    own = offsets[a : b + 1].tolist()
                    columns = [
                        pa.array(doc_ids[a:b], mask=np.arange(a, b) < row["nulls"]),
                        pa.array(offsets[a:b] + row["base"]),
                        pa.array(np.diff(offsets[a : b + 1])),
                        pa.array([zlib.crc32(ids[x:y].astype("<u4")) for x, y in zip(own[:-1], own[1:], strict=True)], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array([ids[x:y].tolist() for x, y in zip(own[:-1], own[1:], strict=True)], pa.list_(pa.int64())))
                    yield pa.record_batch(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return shards.repartition(parts(shards.sparkSession)).mapInArrow(tidy(run), schema)
