"""Approximate nearest neighbours by an inverted multi-index.

Both halves of each normalised vector are quantised separately, so that K
centroids a half give K*K cells. A query walks the centroid pairs by summed
distance with a heap until the cells it has passed hold enough entries; those
entries are reranked by exact cosine in double precision.

The codebooks are fitted on a bounded sample (``sample_rows``); every row is
indexed. How many entries a walk must pass is measured on that sample too: the
share of its rows that reaches ``target_recall`` there (0.95, as the sample errs), by whole walks of some of its rows, which run as tasks. Data with structure
get short walks, data without get long ones.

Defined results: vectors that are null, zero, of another length than most of
the sample, or that hold null or non-finite components take no part, nor do
rows without an id. A query that finds fewer candidates returns them all.
Ties go to the smaller id. Rows with the same id are separate candidates but
one query (its least vector). An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.llm.common import bounded_sample, scratch


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1))


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centroids = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        nearest = _distances(x, centroids).argmin(1)
        for j in range(len(centroids)):
            if (own := x[nearest == j]).size:
                centroids[j] = own.mean(0)
    return centroids


def walk(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, enough: float) -> list[int]:
    """Cells by summed half-distance until they hold ``enough`` entries (multi-sequence algorithm)."""
    first, second, k2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable"), len(d2)
    heap, seen, cells, passed = [(d1[first[0]] + d2[second[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and passed < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(first[i]) * k2 + int(second[j])
        if counts[cell]:
            cells.append(cell)
            passed += int(counts[cell])
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(first) and b < k2 and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (d1[first[a]] + d2[second[b]], a, b))
    return cells


class MultiIndex:
    """Two half codebooks and the share of entries that a walk must pass."""

    def __init__(self, c1: np.ndarray, c2: np.ndarray, dim: int, share: float):
        self.c1, self.c2, self.dim, self.share = c1, c2, dim, share

    @property
    def cells(self) -> int:
        return len(self.c1) * len(self.c2)

    def halves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.dim // 2
        return _distances(unit[:, :half], self.c1), _distances(unit[:, half:], self.c2)

    def cell_of(self, unit: np.ndarray) -> np.ndarray:
        d1, d2 = self.halves(unit)
        return d1.argmin(1) * len(self.c2) + d2.argmin(1)

    @classmethod
    def fit(cls, spark: SparkSession, x: np.ndarray, centroids: int, k: int, target_recall: float, seed: int, trials: int = 512) -> MultiIndex:
        unit, dim = _unit(x), x.shape[1]
        half = dim // 2
        made = cls(_kmeans(unit[:, :half], centroids, seed), _kmeans(unit[:, half:], centroids, seed + 1), dim, 1.0)
        cell, asked = made.cell_of(unit), min(trials, len(unit))
        counts = np.bincount(cell, minlength=made.cells)
        near = unit[:asked] @ unit.T
        near[np.arange(asked), np.arange(asked)] = -2
        k = min(k, len(unit) - 1)
        if k < 1:
            return made
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        trial = spark.sparkContext.broadcast((unit[:asked], counts, cell[best]))  # of the sample's size

        def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """How many entries a whole walk passes up to the cells of each trial's nearest rows."""
            x, counts, cells = trial.value
            for b in batches:
                needed = []
                for i in b.column("id").to_pylist():
                    d1, d2 = made.halves(x[i : i + 1])
                    order = walk(d1[0], d2[0], counts, np.inf)
                    upto = dict(zip(order, np.cumsum(counts[order]).tolist(), strict=True))
                    needed += [upto[int(c)] for c in cells[i]]
                yield pa.RecordBatch.from_arrays([pa.array(needed, pa.int64())], ["passed"])

        needed = spark.range(0, asked, 1, min(asked, 64)).mapInArrow(passed, "passed long").toArrow()["passed"].to_numpy()  # k numbers a trial
        made.share = min(1.0, float(np.quantile(needed, target_recall)) / len(unit))
        return made


def valid(vec_id: Column, embedding: Column) -> Column:
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vec_id.isNotNull() & embedding.isNotNull() & F.coalesce(finite & F.exists(embedding, lambda v: v != 0), F.lit(False))


def nearest(
    vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
    centroids: int | None = None, sample_rows: int = 8192, target_recall: float = 0.95, shard_rows: int = 16384,
    query_block: int = 65536, seed: int = 7,
) -> DataFrame:
    """The ``k`` nearest rows of each row that satisfies ``queries`` (an expression over ``id_col``).

    ``centroids`` of a half: by default four times the fourth root of the rows, 16 to 512.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), queries.alias("asked")).where(valid(F.col("id"), F.col("v")))
    sample = bounded_sample(rows.select("v", F.xxhash64("id", "v").alias("h")), "h", sample_rows).select("v").toArrow()["v"].to_pylist()
    if not sample:
        return spark.createDataFrame([], schema)
    if centroids is None:
        centroids = min(512, max(16, round(4 * rows.count() ** 0.25)))
    lengths = [len(v) for v in sample]
    dim = max(set(lengths), key=lambda n: (lengths.count(n), n))
    index = MultiIndex.fit(spark, np.array([v for v in sample if len(v) == dim], dtype=np.float64), centroids, k, target_recall, seed)
    rows = rows.where(F.size("v") == dim)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = index.cell_of(_unit(_vectors(b.column("v"), dim))) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), b.column("asked"), pa.array(cell, pa.int32())], ["id", "v", "asked", "cell"])

    entries = scratch(rows.mapInArrow(assign, f"id long, v {rows.schema['v'].dataType.simpleString()}, asked boolean, cell int"), "multi-index")
    # One count per cell: at most centroids squared numbers, whatever the number of rows.
    counts = np.zeros(index.cells, dtype=np.int64)
    asked = np.zeros(index.cells, dtype=np.int64)
    for cell, n, q in entries.groupBy("cell").agg(F.count("*"), F.count_if("asked")).collect():
        counts[cell], asked[cell] = n, q
    # Cells share a shard until it is full; a cell beyond a shard's size is split over several.
    base, parts, at, room = np.zeros(index.cells, dtype=np.int64), np.ones(index.cells, dtype=np.int64), 0, shard_rows
    for cell, n in enumerate(counts.tolist()):
        if n > room:
            at, room = at + 1, shard_rows
        base[cell], parts[cell] = at, -(-max(n, 1) // shard_rows)
        at, room = (at + int(parts[cell]), shard_rows) if n > shard_rows else (at, room - n)
    enough = max(k + 1, index.share * counts.sum())
    # Queries of near cells share a block, so that a block asks for few cells; a cell of more queries than a block has several.
    block_of, blocks_of = (np.cumsum(asked) - asked) // query_block, -(-np.maximum(asked, 1) // query_block)
    deal = spark.sparkContext.broadcast((base, parts, counts, block_of, blocks_of))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, parts, counts, block_of, blocks_of = deal.value
        for b in batches:
            if not b.num_rows:
                continue
            d1, d2 = index.halves(_unit(_vectors(b.column("v"), dim)))
            for i in range(b.num_rows):
                by_shard: dict[int, list[int]] = {}
                for cell in walk(d1[i], d2[i], counts, enough):
                    for s in range(int(base[cell]), int(base[cell] + parts[cell])):
                        by_shard.setdefault(s, []).append(cell)
                n, q, own = len(by_shard), b.column("id")[i].as_py(), b.column("own")[i].as_py()
                block = int(block_of[own]) + q % int(blocks_of[own])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([q] * n, pa.int64()), pa.array([b.column("v")[i].as_py()] * n, b.column("v").type), pa.array(list(by_shard), pa.int64()), pa.array(list(by_shard.values()), pa.list_(pa.int32())), pa.array([block] * n, pa.int64())],
                    ["id", "v", "shard", "cells", "block"],
                )

    kind = rows.schema["v"].dataType.simpleString()
    one = entries.where("asked").groupBy("id").agg(F.min(F.struct("v", "cell")).alias("q")).select("id", "q.v", F.col("q.cell").alias("own"))
    probes = scratch(one.mapInArrow(probe, f"id long, v {kind}, shard long, cells array<int>, block long"), "probes")
    needed = probes.select("block", F.explode("cells").alias("cell")).distinct()  # an entry goes to the blocks that ask for its cell
    probes = probes.withColumn("cell", F.lit(None).cast("int"))
    places = spark.createDataFrame([(c, int(base[c]), int(parts[c])) for c in range(index.cells) if counts[c]], "cell int, base long, parts long")
    held = (
        entries.join(F.broadcast(places), "cell").join(needed, "cell")
        .select("id", "v", (F.col("base") + F.pmod(F.xxhash64("id"), "parts")).alias("shard"), F.lit(None).cast("array<int>").alias("cells"), "block", "cell")
    )

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by (shard, block): the shard's entries first, then the queries, a batch at a time."""
        key, ids, vecs, cells, ready = None, [], [], [], None
        for b in batches:
            shard, block = b.column("shard").to_numpy(), b.column("block").to_numpy()
            entry = ~np.asarray(b.column("cell").is_null())
            edges = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(block) != 0)) + 1).tolist(), b.num_rows]
            out: list[tuple[int, int, float]] = []
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if key != (now := (shard[lo], block[lo])):
                    key, ids, vecs, cells, ready = now, [], [], [], None
                split = lo + int(entry[lo:hi].sum())
                if split > lo:
                    part = b.slice(lo, split - lo)
                    ids.append(part.column("id").to_numpy())
                    vecs.append(_vectors(part.column("v"), dim))
                    cells.append(part.column("cell").to_numpy())
                if split == hi or not ids:
                    continue
                if ready is None:
                    x, i, c = np.concatenate(vecs), np.concatenate(ids), np.concatenate(cells)
                    order = np.argsort(c, kind="stable")
                    x, i, c = x[order], i[order], c[order]
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    ready = x, i, c, np.sqrt((x * x).sum(axis=1))
                x, i, c, norm = ready
                part = b.slice(lo + (split - lo), hi - split)
                for q, v, want in zip(part.column("id").to_pylist(), _vectors(part.column("v"), dim), part.column("cells").to_pylist(), strict=True):
                    v = v / np.abs(v).max()
                    want = np.array(sorted(want), dtype=np.int64)
                    spans = [(a, z) for a, z in zip(np.searchsorted(c, want, "left"), np.searchsorted(c, want, "right"), strict=True) if z > a]
                    pick = np.concatenate([np.arange(a, z) for a, z in spans]) if spans else np.empty(0, np.int64)
                    pick = pick[i[pick] != q]
                    # Row by row, so that equal vectors get equal scores.
                    score = (x[pick] * v).sum(axis=1) / (norm[pick] * np.sqrt((v * v).sum()))
                    best = np.lexsort((i[pick], -score))[:k]
                    out += [(q, int(i[pick[j]]), float(score[j])) for j in best]
            yield pa.RecordBatch.from_arrays([pa.array([o[n] for o in out], t) for n, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.float64()))], ["query_id", "vec_id", "score"])

    dealt = held.unionByName(probes).repartition("shard", "block").sortWithinPartitions("shard", "block", F.col("cell").isNull())
    ranked = dealt.mapInArrow(rerank, "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return ranked.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
