"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing, exact reranking.

Inner products become distances by one more component (sqrt(M^2 - |x|^2), M the largest length;
0 for queries). A table cuts HASHES Gaussian projections into slots; a query visits the buckets of
each table in the order of their estimated chance to hold a neighbour until the chances add up to
``coverage``. Large buckets are cut into tiles. Each task reranks its part of the candidates in
double precision and keeps the best of each query; Spark merges the tables.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from trailcast.llm import common
from trailcast.llm.vectors import by_dimension

#: Rows, at most, of the sample that the neighbours' similarity is estimated from, and its queries.
SAMPLE_ROWS, SAMPLE_QUERIES = 20_000, 64
#: Rows of a tile of a bucket.
TILE = 8192
#: Queries that a task scores at once.
QUERY_BLOCK = 256


@dataclass(frozen=True)
class Index:
    """Parameters of an index. More hashes make smaller buckets: about SLOTS**hashes of them."""

    dimension: int
    longest: float
    cosine: float  # of a query and its k-th neighbour, after the change to distances
    tables: int = 2
    hashes: int = 2
    slots: int = 7
    slot_width: float = 1.0
    seed: int = 5

    def draw(self) -> tuple[np.ndarray, np.ndarray]:
        """Projections (dimension + 1, tables * hashes) and offsets."""
        rng = np.random.default_rng(self.seed)
        m = self.tables * self.hashes
        return rng.standard_normal((self.dimension + 1, m)), rng.uniform(-0.5, 0.5, m) * self.slot_width

    def rows(self, matrix: np.ndarray) -> np.ndarray:
        """Bucket of each row in each table. The outer slots are open."""
        projections, offsets = self.draw()
        scaled = matrix / self.longest
        rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", scaled, scaled)))
        value = scaled @ projections[:-1] + rest[:, None] * projections[-1]
        slot = np.clip(np.floor((value + offsets) / self.slot_width + self.slots / 2), 0, self.slots - 1).astype(np.int64)
        return slot.reshape(len(matrix), self.tables, self.hashes) @ (self.slots ** np.arange(self.hashes))

    def probes(self, matrix: np.ndarray, coverage: float) -> Iterator[tuple[int, int, np.ndarray]]:
        """(query, table, buckets in the order of their estimated success), until they sum to ``coverage``."""
        projections, offsets = self.draw()
        value = (matrix / np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]) @ projections[:-1]
        # Given the query's projection, a neighbour's is normal around cosine times it.
        edges = (np.arange(1, self.slots) - self.slots / 2) * self.slot_width
        z = (edges[None, None, :] - offsets[None, :, None] - self.cosine * value[:, :, None]) / math.sqrt(
            max(1e-6, 1 - self.cosine**2))
        below = np.concatenate([np.zeros((*value.shape, 1)), _normal(z), np.ones((*value.shape, 1))], axis=2)
        chance = np.diff(below, axis=2).reshape(len(matrix), self.tables, self.hashes, self.slots)
        combinations = np.array(list(itertools.product(range(self.slots), repeat=self.hashes)))
        codes = combinations @ (self.slots ** np.arange(self.hashes))
        for q in range(len(matrix)):
            for t in range(self.tables):
                p = np.ones(len(codes))
                for h in range(self.hashes):
                    p *= chance[q, t, h][combinations[:, h]]
                order = np.argsort(-p, kind="stable")
                visits = int(np.searchsorted(np.cumsum(p[order]), coverage - 1e-12)) + 1
                yield q, t, codes[order[:visits]]


def _normal(z: np.ndarray) -> np.ndarray:
    """Standard normal distribution function (error below 1e-4: it only orders buckets)."""
    return 0.5 * (1.0 + np.tanh(0.7978845608 * (z + 0.044715 * z**3)))


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for at, matrix in by_dimension(batch.column(1)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[at], pa.int64()), pa.array([matrix.shape[1]] * len(at), pa.int32()),
                 pa.array(np.sqrt(np.einsum("ij,ij->i", matrix, matrix))), pa.array([r.tobytes() for r in matrix], pa.binary())],
                ["id", "d", "length", "vector"])


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, d, length, vector) of the rows that take part, written once."""
    return common.write_table(vectors.where(F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("v")).mapInArrow(
        _usable, "id long, d int, length double, vector binary"))


def _cosines(k: int):
    """(d, cosine) of one dimension, from its sampled rows."""
    def run(table: pa.Table) -> pa.Table:
        taken = sorted(zip(table.column("id").to_pylist(), table.column("vector").to_pylist()))[:SAMPLE_ROWS]
        n, longest = table.column("n")[0].as_py(), table.column("longest")[0].as_py()
        sample = np.stack([np.frombuffer(v) for _, v in taken])
        queries = sample[:: max(1, len(sample) // SAMPLE_QUERIES)]
        scores = (queries / np.sqrt(np.einsum("ij,ij->i", queries, queries))[:, None]) @ sample.T / longest
        rank = min(len(sample), 1 + max(1, round(k * len(sample) / n)))  # the first is the query itself
        cosine = float(np.median(-np.partition(-scores, rank - 1, axis=1)[:, rank - 1]))
        return pa.table({"d": table.column("d")[:1], "cosine": pa.array([min(max(cosine, 0.0), 0.999)])})

    return run


def fit(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(d, longest, cosine, blocks): what the index of each asked dimension needs, and the blocks of its queries.

    The usual similarity of neighbours comes from a bounded sample of each dimension. One row a dimension.
    """
    sizes = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).join(
        asked.groupBy("d").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks")), "d")
    sizes = common.write_table(sizes)
    share = F.least(F.lit(1.0), 0.9 * SAMPLE_ROWS / F.col("n"))
    taken = rows.join(F.broadcast(sizes), "d").where(
        F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.floor(share * 1_000_000)).select("d", "n", "longest", "id", "vector")
    cosines = taken.groupBy("d").applyInArrow(_cosines(k), "d int, cosine double")
    return common.write_table(sizes.join(cosines, "d", "left").select(
        "d", "longest", F.coalesce("cosine", F.lit(0.3)).alias("cosine"), "blocks"))


def _indexed(batches: Iterator[pa.RecordBatch], options: dict) -> Iterator[tuple[Index, pa.RecordBatch, np.ndarray]]:
    """Rows of each dimension of each batch, with its index and their vectors."""
    for batch in batches:
        dimensions = batch.column("d").to_numpy()
        for d in np.unique(dimensions).tolist():
            own = batch.take(pa.array(np.flatnonzero(dimensions == d)))
            index = Index(d, own.column("longest")[0].as_py(), own.column("cosine")[0].as_py(), **options)
            yield index, own, np.stack([np.frombuffer(x) for x in own.column("vector").to_pylist()])


#: Columns of an indexed row or of a query's visit.
_ENTRY = "d int, blocks int, id long, vector binary, hash_table int, bucket long"


def _entries(options: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for index, own, matrix in _indexed(batches, options):
            codes = index.rows(matrix)
            for t in range(index.tables):
                yield pa.RecordBatch.from_arrays(
                    [*(own.column(c) for c in ("d", "blocks", "id", "vector")), pa.array(np.full(own.num_rows, t, np.int32)),
                     pa.array(codes[:, t])], ["d", "blocks", "id", "vector", "hash_table", "bucket"])

    return run


def _visits(options: dict, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for index, own, matrix in _indexed(batches, options):
            at, tables, buckets = [], [], []
            for q, t, codes in index.probes(matrix, coverage):
                at.append(np.full(len(codes), q))
                tables.append(np.full(len(codes), t, np.int32))
                buckets.append(codes)
            at = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_arrays(
                [*(own.column(c).take(at) for c in ("d", "blocks", "id", "vector")), pa.array(np.concatenate(tables)),
                 pa.array(np.concatenate(buckets))], ["d", "blocks", "id", "vector", "hash_table", "bucket"])

    return run


def _rerank(k: int):
    def run(table: pa.Table) -> pa.Table:
        asked = table.column("query").to_numpy(zero_copy_only=False).astype(bool)
        ids = table.column("id").to_numpy()
        vectors = table.column("vector").to_pylist()
        rows, queries = np.flatnonzero(~asked), np.flatnonzero(asked)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(rows) and len(queries):
            row_ids = ids[rows]
            matrix = np.stack([np.frombuffer(vectors[i]) for i in rows])
            # An id counts once: so many rows hold k ids at least.
            repeats = int(np.unique(row_ids, return_counts=True)[1].max())
            most = k * repeats
            for start in range(0, len(queries), QUERY_BLOCK):
                these = queries[start:start + QUERY_BLOCK]
                block = np.stack([np.frombuffer(vectors[i]) for i in these])
                scores = block @ matrix.T
                scores[ids[these][:, None] == row_ids[None, :]] = -np.inf
                edge = -np.partition(-scores, most - 1, axis=1)[:, most - 1] if len(rows) > most else np.full(len(these), -np.inf)
                # Scores within rounding of the last are recomputed row by row, so that equal vectors tie.
                edge = edge - 1e-9 * (1 + np.abs(edge))
                for q in range(len(these)):
                    at = np.flatnonzero((scores[q] >= edge[q]) & (scores[q] > -np.inf))
                    exact = (matrix[at] * block[q]).sum(axis=1)
                    best = np.lexsort((row_ids[at], -exact))
                    if repeats > 1:
                        best = best[np.sort(np.unique(row_ids[at[best]], return_index=True)[1])]
                    best = best[:k]
                    out.append((np.full(len(best), ids[these[q]]), row_ids[at[best]], exact[best]))
        columns = [np.concatenate([o[c] for o in out]) if out else np.zeros(0) for c in range(3)]
        return pa.table({"query_id": pa.array(columns[0].astype(np.int64)), "vec_id": pa.array(columns[1].astype(np.int64)),
                         "score": pa.array(columns[2].astype(float))})

    return run


def _found(rows: DataFrame, queries: DataFrame, fitted: DataFrame, k: int, coverage: float, options: dict) -> DataFrame:
    """(query_id, vec_id, score): the best k of each visited tile, merged over tables."""
    fits, bucket = F.broadcast(fitted), ["d", "hash_table", "bucket"]
    entries = rows.join(fits, "d").mapInArrow(_entries(options), _ENTRY)
    sizes = common.write_table(entries.groupBy(*bucket).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("int").alias("parts")))
    # At most tables * slots**hashes rows a dimension, a parameter of the index.
    parts = F.broadcast(sizes)
    place = F.xxhash64("id", "vector")
    keyed = entries.join(parts, bucket).withColumn("tile", F.pmod(place, F.col("parts")).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("query", F.lit(False))
    visits = queries.join(fits, "d").mapInArrow(_visits(options, coverage), _ENTRY).join(parts, bucket).withColumn(
        "tile", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn(
        "block", F.pmod(place, F.col("blocks")).cast("int")).withColumn("query", F.lit(True))
    group = [*bucket, "tile", "block"]
    both = keyed.unionByName(visits).select("id", "vector", "query", *group)
    best = both.groupBy(*group).applyInArrow(_rerank(k), "query_id long, vec_id long, score double")
    return best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, coverage: float = 0.85, **options) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query, by inner product.

    Both tables have vec_id and embedding. A row is never its own query's neighbour; ties go to the
    smaller vec_id. Rows without an id and vectors that are null, zero or hold null or non-finite
    components take no part; queries meet rows of their dimension only. Rows with one id count once,
    with their best score. Every dimension has its index, however few rows it has; all are searched in
    the same jobs. Queries that find fewer than k visit all buckets, so they return all candidates if
    there are fewer. Other columns are ignored.
    """
    rows, asked = usable(vectors), usable(queries)
    fitted = fit(rows, asked, k)
    part = common.write_table(_top(_found(rows, asked, fitted, k, coverage, options), k))
    enough = part.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("id"))
    short = common.write_table(asked.join(enough, "id", "left_anti"))
    if short.isEmpty():
        return part
    complete = _top(_found(rows, short, fitted, k, 2.0, options), k)
    return part.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(complete)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
