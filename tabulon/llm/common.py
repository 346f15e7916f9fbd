"""Shared storage, word splitting and hashing for the training-data operators.

Words are maximal runs outside ASCII white space (0x20, 0x09-0x0D), after
lower-casing A-Z where an operator asks for it. A null text counts as empty.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from functools import wraps

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task handles at once.
SLICE_BYTES = 8 << 20

WORD = r"[^\x20\x09-\x0D]+"


# ------------------------------------------------------------------ storage


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and there is one machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tabulon-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table or for files in the shared folder."""
    return f"{shared_dir(spark)}/tabulon/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Tables of the scopes that are open, the innermost last.
_scopes: list[list[DataFrame]] = []


@contextmanager
def scope():
    """At its end the tables stored inside go, but for those handed to ``keep``: what is returned must read no others."""
    _scopes.append([])
    try:
        yield
    finally:
        drop(*_scopes.pop())


def store(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def keep(table: DataFrame) -> DataFrame:
    """Hand a table stored in the innermost scope on to what is around it."""
    own = _scopes.pop()
    del own[next(i for i, t in enumerate(own) if t is table)]
    if _scopes:
        _scopes[-1].append(table)
    _scopes.append(own)
    return table


def drop(*tables: DataFrame) -> None:
    """Remove stored tables that nothing unstored reads any more."""
    for t in tables:
        _delete(t.sparkSession, t.stored_at)


def drop_kind(table: DataFrame, kind: str) -> None:
    """Remove the rows of one kind of a table stored by kind, once nothing unstored reads them any more."""
    _delete(table.sparkSession, f"{table.stored_at}/kind={kind}")


def forget(spark: SparkSession) -> None:
    """Have Spark's cleaner remove the shuffle files of queries that are through: it waits for the driver's garbage collector to meet them."""
    gc.collect()
    spark._jvm.System.gc()


def clean(spark: SparkSession) -> None:
    """Remove every table that this application stored; results not yet read are lost with them."""
    _delete(spark, f"{shared_dir(spark)}/tabulon/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def open_fs(uri: str):
    """(file system, path) of a shared path, from inside a task."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def text_table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(column: str = "doc_id"):
    """The id as text, null as the empty string: the input of every id-based split."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


# ------------------------------------------------------------------- memory


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks, and an executor has several."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """A task's generator that gives its memory back when it is through."""

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


# ------------------------------------------------------------- Arrow slices


def plain_string(col) -> pa.Array:
    """A string column as one contiguous array without nulls.

    The copy matters: after a cast, a slice's offsets still begin inside its old
    buffer, and the string kernels then read other bytes.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    return pa.concat_arrays([pc.fill_null(col, "")])


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut or join record batches so that each holds about ``limit`` bytes of ``column``: whole rows, one at least."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = int(np.searchsorted(ends, before + max(1, limit - size), side="right"))
            stop = max(stop, start if held else start + 1)
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1]) - before
                start = stop
            if start < batch.num_rows or size >= limit:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(held) == 1:
        return held[0]
    table = pa.Table.from_batches(held).combine_chunks()
    return table.to_batches()[0] if table.num_rows else held[0]


# -------------------------------------------------------------------- words


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array]:
    """(offsets of length n + 1, flat words) of a large_string array without nulls."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    empty = pc.equal(pc.binary_length(flat), 0)
    if len(flat) and pc.any(empty).as_py():  # white space at either end, and empty texts, give empty pieces
        gone = np.concatenate([[0], np.cumsum(empty.to_numpy(zero_copy_only=False))])
        return offsets - gone[offsets], flat.filter(pc.invert(empty))
    return offsets, flat


def word_codes(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(index of each word, distinct words)."""
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def hash_strings(values: pa.Array) -> np.ndarray:
    """64-bit hashes that are alike in every process."""
    if not len(values):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(values.to_pylist(), dtype=object), categorize=False)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd_constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def ragged_take(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each run, one after another."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    out = np.ones(int(ends[-1]), np.int64)
    some = lengths > 0
    s, n = starts[some], lengths[some]
    at = np.concatenate([[0], np.cumsum(n)[:-1]])
    out[at] = s
    out[at[1:]] -= s[:-1] + n[:-1] - 1
    return np.cumsum(out)
