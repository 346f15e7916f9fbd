"""Approximate nearest neighbours by an inverted multi-index.

Two codebooks quantise the halves of each vector; a pair of centroids is a cell.
A query walks the cells by summed distance with a heap until they hold a given
share of all vectors, and these are reranked by their exact distance. The share
is measured on the sample that the codebooks come from: the smallest one that
finds ``recall`` of the true neighbours there.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import store, tidy


@dataclass(frozen=True)
class IndexParams:
    sample: int = 8192  # vectors that codebooks and share are fitted on: those with the smallest hash of their id
    centroids: int = 64  # of each half at most
    rounds: int = 12
    recall: float = 0.96  # aimed at on the sample
    probes: int = 256  # of the sample's vectors, to measure recall with
    block: int = 8192  # vectors in a block of the index
    queries: int = 2048  # queries that meet a block in one task
    seed: int = 3


def _squares(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (centers**2).sum(1) - 2 * x @ centers.T, 0)


def _codebook(x: np.ndarray, k: int, rounds: int, rng) -> np.ndarray:
    centers = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _squares(x, centers).argmin(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        counts = np.bincount(own, minlength=len(centers))
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.integers(0, len(x), len(centers))])
    return centers


@dataclass
class MultiIndex:
    """Codebooks of both halves, and the share of all vectors that a query looks at."""

    first: np.ndarray
    second: np.ndarray
    share: float
    dim: int

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        return _squares(x[:, :cut], self.first), _squares(x[:, cut:], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def walk(self, a: np.ndarray, b: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
        """Cells by summed distance of their centroids until they hold ``enough`` vectors; empty ones are passed over."""
        order_a, order_b = a.argsort(kind="stable"), b.argsort(kind="stable")
        da, db = a[order_a].tolist(), b[order_b].tolist()
        heap, seen, out, held = [(da[0] + db[0], 0, 0)], {(0, 0)}, [], 0
        while heap and held < enough:
            _, i, j = heapq.heappop(heap)
            cell = int(order_a[i]) * len(db) + int(order_b[j])
            if counts[cell]:
                out.append(cell)
                held += int(counts[cell])
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(da) and y < len(db) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (da[x] + db[y], x, y))
        return out


def fit(x: np.ndarray, p: IndexParams, k_nearest: int) -> MultiIndex:
    """``x``: the sample, one vector a row."""
    rng = np.random.default_rng(p.seed)
    cut = x.shape[1] // 2 or 1
    k = max(1, min(p.centroids, len(x)))
    second = _codebook(x[:, cut:], k, p.rounds, rng) if x.shape[1] > 1 else np.zeros((1, 0))
    index = MultiIndex(_codebook(x[:, :cut], k, p.rounds, rng), second, 1.0, x.shape[1])
    probes = rng.permutation(len(x))[: p.probes]
    kn = min(k_nearest, len(x) - 1)
    if kn < 1:
        return index
    true = _squares(x[probes], x)
    true[np.arange(len(probes)), probes] = np.inf
    near = np.argpartition(true, kn - 1, axis=1)[:, :kn]
    a, b = index.halves(x[probes])
    cells = index.cells(x)
    summed = a[:, cells // len(second)] + b[:, cells % len(second)]
    # how many of the sample a walk has met when it has met the neighbour's cell
    rank = np.stack([np.searchsorted(np.sort(s), s[n], side="right") for s, n in zip(summed, near, strict=True)])
    index.share = min(1.0, float(np.quantile(rank, p.recall)) / len(x))
    return index


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (doubles): without null, empty and zero vectors and those with null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, p: IndexParams = IndexParams()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: up to ``k`` nearest of every query by Euclidean distance.

    Both inputs come from ``usable``. A query's own id is no candidate. Ties go
    to the smaller id. Vectors of another length than the sample's most common
    one take no part. Rows equal in id and vector are one. Of equal vectors the
    k + 1 smallest ids are indexed, which is all that an answer can hold. A query
    given twice is answered once for each different vector. Empty inputs give none.
    """
    spark = vectors.sparkSession
    sample = vectors.orderBy(F.xxhash64("id", F.lit(p.seed)), "id").limit(p.sample).toArrow()["v"].to_pylist()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], schema)
    lengths = [len(v) for v in sample]
    dim = max(set(lengths), key=lambda n: (lengths.count(n), n))
    x = np.array([v for v in sample if len(v) == dim], np.float64)
    index = fit(np.unique(x, axis=0), p, k)
    shared = spark.sparkContext.broadcast(index)

    def cells(batches):
        for b in batches:
            if b.num_rows:
                v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)
                yield pa.record_batch([b.column("id"), b.column("v"), pa.array(shared.value.cells(v).astype(np.int32))], names=["id", "v", "cell"])

    few = Window.partitionBy("v").orderBy("id")
    once = vectors.where(F.size("v") == dim).dropDuplicates(["id", "v"])
    distinct = once.withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1).drop("n")
    coded = store(distinct.mapInArrow(tidy(cells), "id long, v array<double>, cell int"), "coded")
    # counts of cells: centroids squared at most
    counted = coded.groupBy("cell").count().toArrow()
    counts = np.zeros(len(index.first) * len(index.second), np.int64)
    counts[counted["cell"].to_numpy()] = counted["count"].to_numpy()
    enough = max(k + 1, int(np.ceil(index.share * counts.sum())))
    # cells in order fill blocks; one that is larger than a block has blocks of its own
    first, many, block, room = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, p.block
    for c in np.flatnonzero(counts):
        if counts[c] > room:
            block, room = block + 1, p.block
        first[c] = block
        if counts[c] > p.block:
            many[c] = -(-counts[c] // p.block)
            block, room = block + int(many[c]), p.block
        else:
            room -= int(counts[c])
    plan = spark.sparkContext.broadcast((counts, first, many))

    def probe(batches):
        n_cells, first, many = plan.value
        for pdf in batches:
            if not len(pdf):
                continue
            a, b = shared.value.halves(np.stack(pdf["v"].to_numpy()))
            rows = []
            for i in range(len(pdf)):
                own = np.array(shared.value.walk(a[i], b[i], n_cells, enough), np.int32)
                of_block: dict[int, list[int]] = {}
                for c in own.tolist():
                    for j in range(int(many[c])):
                        of_block.setdefault(int(first[c]) + j, []).append(c)
                rows += [(pdf["quid"].iloc[i], pdf["id"].iloc[i], pdf["v"].iloc[i], blk, cs) for blk, cs in of_block.items()]
            yield pd.DataFrame(rows, columns=["quid", "id", "v", "block", "cells"])

    asked = queries.where(F.size("v") == dim).dropDuplicates(["id", "v"])
    asked = store(asked.withColumn("quid", F.monotonically_increasing_id()), "queries")
    n_groups = max(1, -(-asked.count() // p.queries))
    group = F.pmod(F.xxhash64("quid"), F.lit(n_groups)).cast("int")
    probes = asked.mapInPandas(probe, "quid long, id long, v array<double>, block long, cells array<int>").withColumn("part", group)
    table = spark.createDataFrame(pd.DataFrame({"cell": np.flatnonzero(counts).astype(np.int32), "first": first[counts > 0], "many": many[counts > 0]}), "cell int, first long, many long")
    dealt = coded.join(F.broadcast(table), "cell")  # as many rows as there are cells: centroids squared at most
    dealt = dealt.select("id", "v", "cell", (F.col("first") + F.pmod(F.xxhash64("id"), "many")).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("part"))

    def rerank(q: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(rows):
            v, ids, cell = np.stack(rows["v"].to_numpy()), rows["id"].to_numpy(), rows["cell"].to_numpy()
            for quid, own, x, cs in zip(q["quid"], q["id"], q["v"], q["cells"], strict=True):
                at = np.flatnonzero(np.isin(cell, cs) & (ids != own))
                score = np.sqrt(((v[at] - x) ** 2).sum(1))
                best = np.lexsort((ids[at], score))[:k]
                found.append(pd.DataFrame({"quid": quid, "query_id": own, "vec_id": ids[at][best], "score": score[best]}))
        return pd.concat(found) if found else pd.DataFrame({"quid": [], "query_id": [], "vec_id": [], "score": []})

    best = probes.groupBy("block", "part").cogroup(dealt.groupBy("block", "part")).applyInPandas(rerank, "quid long, query_id long, vec_id long, score double")
    order = Window.partitionBy("quid").orderBy("score", "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast(T.IntegerType()).alias("rank"), "vec_id", "score")
