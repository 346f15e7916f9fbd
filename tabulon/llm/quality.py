"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are its byte pairs (hashed to a fixed number of columns) and a few
signs of its words: capitals, marks at a word's end, words said twice in a row,
words that are new in it. Labelled texts, a bounded sample of them, give idf
weights and a truncated SVD; their latent vectors and labels are broadcast (a
fixed size), and every document's cosines with all of them are computed in
blocks. The nearest ones vote by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, id_text, plain_string, slices, split_words, tidy, word_codes

PAIRS = 2048
SIGNS = 8
TERMS = PAIRS + SIGNS
#: Documents whose terms are counted at once, and bytes of text in them.
BLOCK, BLOCK_BYTES = 512, 1 << 21


@dataclass(frozen=True)
class VoteParams:
    sample: int = 4096  # labelled texts at most; those with the smallest hash of their id
    dims: int = 48
    neighbours: int = 25
    power: float = 8.0
    threshold: float = 0.7
    seed: int = 5


def term_weights(texts: pa.Array) -> np.ndarray:
    """(texts, TERMS) float32: log-damped counts per text; an empty text has zeros only."""
    n = len(texts)
    out = np.zeros((n, TERMS), np.float32)
    at = 0
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1])
    ends = np.cumsum(sizes)
    while at < n:
        before = int(ends[at - 1]) if at else 0
        to = min(max(at + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, side="right"))), at + BLOCK, n)
        out[at:to] = _block(texts.slice(at, to - at))
        at = to
    return out


def _block(texts: pa.Array) -> np.ndarray:
    n = len(texts)
    own = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[own[0] : own[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    sizes = np.diff(own)
    doc = np.repeat(np.arange(n), sizes)
    out = np.zeros((n, TERMS), np.float32)
    if len(data) > 1:
        same = doc[1:] == doc[:-1]
        pair = (data[:-1].astype(np.uint32) << 8 | data[1:]) * np.uint32(2654435761) >> np.uint32(32 - 11)
        counts = np.bincount((doc[:-1] * PAIRS + pair)[same], minlength=n * PAIRS)
        out[:, :PAIRS] = np.log1p(counts.reshape(n, PAIRS))
    # signs of words, each as a share of the text's words; they weigh as much as a frequent pair
    offsets, flat = split_words(texts, lower=False)
    words = np.diff(offsets)
    index, distinct = word_codes(flat)
    if len(index):
        names = distinct.to_pylist()
        shape = np.array([[w.isupper() and len(w) > 1, not w[-1].isalnum() and w[-1] not in ".,", not any(c.isalnum() for c in w), any(c.isdigit() for c in w)] for w in names], np.float32)
        owner = np.repeat(np.arange(n), words)
        many = np.maximum(words, 1)
        for j in range(4):
            out[:, PAIRS + j] = np.bincount(owner, shape[index, j], minlength=n) / many
        twice = (index[1:] == index[:-1]) & (owner[1:] == owner[:-1])
        out[:, PAIRS + 4] = np.bincount(owner[1:][twice], minlength=n) / many
        fresh = np.unique(owner * np.int64(len(names)) + index) // len(names)
        out[:, PAIRS + 5] = 1 - np.bincount(fresh, minlength=n) / many
        out[:, PAIRS + 6] = np.log1p(words) / 10
        out[:, PAIRS + 7] = words < 5
        out[:, PAIRS:] *= np.sqrt((out[:, :PAIRS] ** 2).sum(1) + 1)[:, None]
    return out


@dataclass
class VoteModel:
    """Of a fixed size, whatever the corpus: TERMS x dims numbers and sample x dims numbers."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    params: VoteParams

    def latent(self, weights: np.ndarray) -> np.ndarray:
        x = (weights * self.idf) @ self.basis
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

    def score(self, texts: pa.Array) -> np.ndarray:
        """0 to 1, rounded to nine digits; texts without terms get the labelled share."""
        p, n = self.params, len(texts)
        out = np.full(n, self.prior)
        k = min(p.neighbours, len(self.labels))
        for a in range(0, n if k else 0, BLOCK):
            x = self.latent(term_weights(texts.slice(a, BLOCK)))
            some = np.flatnonzero(x.any(1))
            cosine = x[some] @ self.vectors.T
            near = np.argpartition(cosine, -k, axis=1)[:, -k:]
            weight = np.clip(np.take_along_axis(cosine, near, 1).astype(np.float64), 1e-6, 1) ** p.power
            out[a + some] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return np.round(out, 9)


def labelled_sample(docs: DataFrame, labels: DataFrame, params: VoteParams, label: str = "quality") -> DataFrame:
    """text, label of at most ``sample`` labelled documents, the ones whose ids have the smallest hashes.

    An id with several labels has the smallest of them, one with several texts the
    first by code points: the model does not depend on the order of rows.
    """
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("double").alias("label")).where("label is not null and __id is not null").groupBy("__id").agg(F.min("label").alias("label"))
    picked = known.orderBy(F.xxhash64(F.col("__id"), F.lit(params.seed)), "__id").limit(params.sample)
    return docs.select(F.col("doc_id").alias("__id"), "text").join(picked, "__id").groupBy("__id").agg(F.min("text").alias("text"), F.min("label").alias("label"))


def fit(sample: DataFrame, params: VoteParams = VoteParams()) -> VoteModel:
    """The latent space of the sample's texts; term weights are counted in tasks and arrive in half precision."""

    def run(batches):
        for b in slices(batches):
            w = term_weights(plain_string(b.column("text"))).astype(np.float16)
            yield pa.record_batch([b.column("__id"), b.column("label"), pa.array([x.tobytes() for x in w], pa.binary())], names=["__id", "label", "w"])

    schema = T.StructType([sample.schema["__id"], T.StructField("label", T.DoubleType()), T.StructField("w", T.BinaryType())])
    got = sample.mapInArrow(tidy(run), schema).toArrow()
    order = pc.sort_indices(got["__id"])
    labels, blobs = got["label"].take(order).to_numpy(), got["w"]
    w = np.empty((len(labels), TERMS), np.float16)
    for i, j in enumerate(order.to_pylist()):
        w[i] = np.frombuffer(blobs[j].as_buffer(), np.float16)
    del got, blobs
    model = latent_space(w, labels, params)
    give_back()
    return model


def top_axes(gram: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Eigenvectors of the ``k`` largest eigenvalues, largest first, by block Krylov spaces: no work space of the matrix's size."""
    v = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(gram), min(2 * k, len(gram)))))[0]
    for _ in range(100):
        blocks = [v]
        for _ in range(4):
            blocks.append(np.linalg.qr(gram @ blocks[-1])[0])
        q = np.linalg.qr(np.hstack(blocks)[:, : len(gram)])[0]
        values, vectors = np.linalg.eigh(q.T @ (gram @ q))
        v, values = q @ vectors[:, ::-1][:, : v.shape[1]], values[::-1][:k]
        if np.abs(gram @ v[:, :k] - v[:, :k] * values).max() <= 1e-11 * max(values[0], 1e-300):
            break
    return v[:, :k]


def latent_space(w: np.ndarray, labels: np.ndarray, params: VoteParams) -> VoteModel:
    """The model of term weights in half precision; they are widened block by block, and only the axes that are kept are worked out."""
    blocks = [slice(a, a + BLOCK) for a in range(0, len(w), BLOCK)]
    idf = np.log((1 + len(w)) / (1 + np.count_nonzero(w, axis=0))).astype(np.float32) + 1
    if not len(w):
        return VoteModel(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, 0.5, params)
    gram = np.zeros((TERMS, TERMS))
    for b in blocks:
        x = w[b].astype(np.float32) * idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        gram += x.T @ x
    basis = top_axes(gram, params.dims, params.seed).astype(np.float32)
    del gram
    model = VoteModel(idf, basis, np.zeros((0, 0)), labels, float(labels.mean()), params)
    model.vectors = np.concatenate([model.latent(w[b].astype(np.float32)) for b in blocks])
    return model


def scored(docs: DataFrame, model: VoteModel, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of every row, then score (0 to 1) and predicted (1 from the threshold on).

    A null or empty text gets the labelled share of good texts as its score. Only
    texts travel to Python; the other columns of a row stay where they are.
    """
    if clash := {*carry} & {"score", "predicted"}:
        raise ValueError(f"columns of the input clash with those of the result: {sorted(clash)}")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            scores, at = np.empty(len(texts)), 0
            while at < len(texts):
                before = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, side="right")))
                scores[at:to] = shared.value.score(plain_string(texts.slice(at, to - at)))
                at = to
            yield pa.array(scores)

    out = docs.select(*carry, F.arrow_udf(tidy(run), T.DoubleType())(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= model.params.threshold).cast("int"))


def held_out(column: str = "doc_id"):
    """Labels of these ids are never learnt from."""
    return F.crc32(id_text(column).cast("binary")) % 4 == 2


def quality_model(docs: DataFrame, labels: DataFrame, params: VoteParams = VoteParams()) -> VoteModel:
    return fit(labelled_sample(docs, labels.where(~held_out()), params), params)
