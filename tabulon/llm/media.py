"""Media columns: content-addressed payloads in tar shards.

Every text becomes an image of 8-bit RGB samples, 64 pixels wide, stored as PNG
under the digest of its payload. Tasks append payloads to tar shards where they
read them, once for each digest that they meet, so that no payload is shuffled;
rows carry digest (32 bytes), shard, offset and length. Metadata columns come from
the first bytes of a member alone; features from the samples read back. Both are
added to the rows of places in one pass, so that they need no join.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, keep, open_fs, parts, plain_string, scope, scratch, slices, store, tidy

WIDTH, CHANNELS = 64, 3
ROW = WIDTH * CHANNELS
PNG = b"\x89PNG\r\n\x1a\n"
HEADER = len(PNG) + 8 + 13 + 4
#: A shard is closed at this size and the task begins another.
SHARD_BYTES = 1 << 30


def payload_of(text: bytes) -> bytes:
    """UTF-8 bytes with spaces up to a positive multiple of one row of pixels."""
    return text.ljust(max(1, -(-len(text) // ROW)) * ROW, b" ")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, level: int = 6) -> bytes:
    """Lossless: each row unfiltered, all rows deflated. Equal payloads give equal bytes."""
    height = len(payload) // ROW
    rows = np.zeros((height, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW)
    return PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, height, 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(start: bytes) -> tuple[int, int, int, int]:
    """(width, height, bit depth, channels) from the first bytes of a file."""
    if start[:8] != PNG or start[12:16] != b"IHDR" or zlib.crc32(start[12:29]) != struct.unpack(">I", start[29:33])[0]:
        raise ValueError("not a PNG header")
    width, height, depth, kind = struct.unpack(">IIBB", start[16:26])
    return width, height, depth, {0: 1, 2: 3, 6: 4}[kind]


def from_png(data: bytes) -> np.ndarray:
    """Samples (height, width, channels) of a PNG that to_png wrote; its checksums are tested."""
    width, height, depth, channels = png_header(data[:HEADER])
    at, body = len(PNG), []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        own = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + own) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IDAT":
            body.append(own)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width * channels + 1)
    if depth != 8 or rows[:, 0].any():
        raise ValueError("only unfiltered rows of 8-bit samples are read")
    return rows[:, 1:].reshape(height, width, channels)


def features(samples: np.ndarray) -> str:
    """Size, mean of each channel in thousandths, contrast and a 64-bit brightness hash, as text."""
    flat = samples.reshape(-1, samples.shape[2])
    sums = flat.sum(0, dtype=np.int64) * 1000 // len(flat)
    grey = samples.sum(2, dtype=np.int64)
    bounds = np.linspace(0, samples.shape[1], 9).astype(int)
    cells = np.stack([x.sum() // max(1, x.size) for row in np.array_split(grey, 8) for x in np.split(row, bounds[1:-1], axis=1)])
    bits = 0
    for one in cells > cells.sum() // len(cells):
        bits = bits << 1 | int(one)
    low, high = int(flat.min()), int(flat.max())
    return f"{samples.shape[1]}x{samples.shape[0]}x{samples.shape[2]} mean={','.join(map(str, sums.tolist()))} range={low}-{high} hash={bits:016x}"


class _Shard:
    """A tar file that grows by whole members."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tar"
        fs, at = open_fs(self.path)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        self.out, self.size = fs.open_output_stream(at), 0

    def add(self, name: str, data: bytes) -> int:
        """Offset of the member's data."""
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head)
        self.out.write(data + b"\0" * (-len(data) % 512))
        at = self.size + len(head)
        self.size = at + len(data) + -len(data) % 512
        return at

    def close(self) -> None:
        self.out.write(b"\0" * 1024)
        self.out.close()


def write_media(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Store every text; one row each: doc_id, n_bytes, digest, shard, offset, length.

    A null text is empty. A task writes a digest once for as long as it knows
    it (a million digests at least); the same payload met by several tasks has a
    member in the shard of each, and ``canonical`` picks one of them for all rows.
    """
    folder = folder or scratch(docs.sparkSession, "media")

    def run(batches):
        shard, known = None, {}
        for batch in slices(batches):
            n_bytes, digests, places = [], [], []
            for text in plain_string(batch.column("text")).cast(pa.large_binary()).to_pylist():
                data = payload_of(text)
                digest = hashlib.sha256(data).digest()
                if digest not in known:
                    if shard is None or shard.size >= SHARD_BYTES:
                        if shard:
                            shard.close()
                        shard = _Shard(folder)
                    if len(known) >= 1 << 20:
                        known.clear()
                    image = to_png(data)
                    known[digest] = (shard.path, shard.add(f"{digest.hex()}.png", image), len(image))
                n_bytes.append(len(text))
                digests.append(digest)
                places.append(known[digest])
            paths, offsets, lengths = zip(*places, strict=True) if places else ((), (), ())
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(digests, pa.binary()), pa.array(paths, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"],
            )
        if shard:
            shard.close()

    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("shard", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())]
    )
    return store(docs.select("doc_id", "text").mapInArrow(tidy(run), schema), "media")


def canonical(media: DataFrame) -> DataFrame:
    """digest, shard, offset, length: one stored place of every payload."""
    place = F.min(F.struct("shard", "offset", "length")).alias("at")
    return media.groupBy("digest").agg(place).select("digest", "at.shard", "at.offset", "at.length")


def dealt(places: DataFrame) -> DataFrame:
    """Neighbouring members of a shard go to one task, which opens the shard once."""
    return places.repartitionByRange(parts(places.sparkSession), "shard", "offset").sortWithinPartitions("shard", "offset")


def read_headers(places: DataFrame) -> DataFrame:
    """Adds width, height, bit_depth, channels to places: reads the first bytes of each member only."""

    def read(f, row):
        return png_header(_range(f, row["offset"], HEADER))

    return _adding(places, read, "width long, height long, bit_depth long, channels long")


def read_features(places: DataFrame) -> DataFrame:
    """Adds payload_bytes, tail_crc32, media_sha256 (32 bytes), feature to places: from the stored bytes, whose payload must have the digest."""

    def read(f, row):
        data = _range(f, row["offset"], row["length"])
        samples = from_png(data)
        payload = samples.tobytes()
        if hashlib.sha256(payload).digest() != row["digest"]:
            raise ValueError(f"{row['shard']} at {row['offset']}: the payload is not {row['digest'].hex()}")
        return len(payload), zlib.crc32(payload[-16:]), hashlib.sha256(data).digest(), features(samples)

    return _adding(places, read, "payload_bytes long, tail_crc32 long, media_sha256 binary, feature string")


def _adding(places: DataFrame, read, columns: str) -> DataFrame:
    """``places`` with what ``read`` finds at each of them in its open shard."""
    added = T.StructType.fromDDL(columns)
    types = [{"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}[f.dataType.simpleString()] for f in added]

    def run(batches):
        now = f = None
        for batch in batches:
            found = []
            for row in batch.select(["digest", "shard", "offset", "length"]).to_pylist():
                if row["shard"] != now:
                    if f:
                        f.close()
                    fs, at = open_fs(row["shard"])
                    now, f = row["shard"], fs.open_input_file(at)
                found.append(read(f, row))
            own = [pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [()] * len(types), types, strict=True)]
            yield pa.record_batch([*batch.columns, *own], names=[*batch.schema.names, *added.names])
        if f:
            f.close()

    return places.mapInArrow(tidy(run), T.StructType([*places.schema, *added]))


def _range(f, offset: int, length: int) -> bytes:
    f.seek(offset)
    return f.read(length)


def media_columns(docs: DataFrame) -> DataFrame:
    """Every row's payload, stored form and feature, joined by digest: equal texts, equal values.

    doc_id, n_bytes, shard, offset, length, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature,
    width, height, bit_depth, channels. The SHA-256 of a payload is its digest, which was compared as it was read back.
    """
    with scope():
        media = keep(write_media(docs))
        places = store(canonical(media), "places")
        looks = keep(store(read_headers(read_features(dealt(places))), "looks"))
    forget(docs.sparkSession)
    return media.select("doc_id", "n_bytes", "digest").join(looks, "digest").select(
        "doc_id", "n_bytes", "shard", "offset", "length", "payload_bytes", F.lower(F.hex("digest")).alias("payload_sha256"), "tail_crc32",
        F.col("length").alias("media_bytes"), F.lower(F.hex("media_sha256")).alias("media_sha256"), "feature", "width", "height", "bit_depth", "channels",
    )
