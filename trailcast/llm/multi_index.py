"""Hard negatives from an inverted multi-index over integer vectors.

Each half of a vector has a codebook; a cell is a pair of half centroids. A half score is at most the
anchor's product with the centroid plus its length times the centroid's radius, so the sum of two half
bounds tops every score in a cell. For each anchor a heap walks the two sorted lists of half bounds
(multi-sequence order) and gives cells by falling bound, until no cell left can change the result: first
a few cells fix a threshold, then all cells not ruled out by it are visited, so the windows are exact.

Codebooks come from a bounded sample; radii and cells cover every row. Cells are cut into tiles, anchors
of near cells share a block, and a (block, tile) pair is one task's matrix product.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from trailcast.llm import common

#: Rows, at most, of the sample that codebooks are fitted on, and steps of the fit.
SAMPLE_ROWS, FIT_STEPS = 20_000, 12
#: Rows of a cell that the size of the codebooks aims at, and centroids of a half, at most.
CELL_ROWS, MOST_CENTROIDS = 2048, 256
#: Rows of a tile; anchors of a block; anchors that are scored at once.
TILE, BLOCK, SCORED = 4096, 2048, 128
#: Rows that the first visit of an anchor covers, at least, for each row that it looks for.
FIRST_ROWS = 400

_ROW = "row long, id long, label long, d int, length double, vector binary, asks boolean"


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, d) if d else np.zeros((len(column), 0), np.int32)


# ---- rows ----


def _integers(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("v")
            sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            values = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.maximum(sizes, 0))
            for d in np.unique(sizes[sizes >= 0]).tolist():
                at = np.flatnonzero(sizes == d)
                with np.errstate(over="ignore", invalid="ignore"):
                    whole = np.floor(scale * values[(ends[at] - d)[:, None] + np.arange(d)[None, :]])
                    square = (whole * whole).sum(axis=1)
                good = np.flatnonzero(square < 2.0**62)  # false for NaN and infinities, too
                own = batch.take(pa.array(at[good]))
                yield pa.RecordBatch.from_arrays(
                    [own.column("row"), own.column("id"), own.column("label"), pa.array(np.full(len(good), d, np.int32)),
                     pa.array(np.sqrt(square[good])), pa.array([x.tobytes() for x in whole[good].astype(np.int32)], pa.binary()),
                     own.column("asks")], ["row", "id", "label", "d", "length", "vector", "asks"])

    return run


# ---- index ----


@dataclass(frozen=True)
class Codebooks:
    """Centroids of the two halves for each dimension of the sample; other dimensions have one centroid, 0."""

    centroids: dict[int, tuple[np.ndarray, np.ndarray]]

    def of(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        return self.centroids.get(d) or (np.zeros((1, d // 2)), np.zeros((1, d - d // 2)))

    def assign(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Nearest centroid and distance to it, for each half."""
        d, at = x.shape[1], 0
        for book in self.of(d):
            half = x[:, at:at + book.shape[1]].astype(float)
            at += book.shape[1]
            code = _nearest(half, book)
            yield code, np.sqrt(((half - book[code]) ** 2).sum(axis=1))

    def bounds(self, x: np.ndarray, radii: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """(anchors, centroids) for each half: no member of the centroid has a larger half score."""
        out, at = [], 0
        for book, radius in zip(self.of(x.shape[1]), radii):
            half = x[:, at:at + book.shape[1]].astype(float)
            at += book.shape[1]
            out.append(half @ book.T + np.sqrt((half**2).sum(axis=1))[:, None] * radius[None, :])
        return out


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book**2).sum(axis=1)[None, :] - 2.0 * (x @ book.T), axis=1)


def _fit_half(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    book = distinct[rng.permutation(len(distinct))[:k]].astype(float)
    for _ in range(FIT_STEPS):
        code = _nearest(x, book)
        sums, sizes = np.zeros_like(book), np.bincount(code, minlength=len(book))
        np.add.at(sums, code, x)
        book = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], book)
    return book


def fit(rows: DataFrame, n: int, cell_rows: int = CELL_ROWS) -> Codebooks:
    """Codebooks from at most ``SAMPLE_ROWS`` rows; their size follows from the number of all rows."""
    share = min(1.0, 0.9 * SAMPLE_ROWS / max(1, n))
    sample = rows.where(F.pmod(F.xxhash64("vector"), F.lit(1_000_000)) < int(share * 1_000_000)).select(
        "d", "vector").limit(SAMPLE_ROWS).toPandas()
    books = {}
    for d, own in sample.groupby("d"):
        if d < 2:
            continue
        cells = max(1.0, n * len(own) / len(sample) / cell_rows)
        k = int(min(MOST_CENTROIDS, max(1, round(cells**0.5))))
        x = np.frombuffer(b"".join(own["vector"]), np.int32).reshape(-1, d)
        books[int(d)] = (_fit_half(x[:, :d // 2], k, 3), _fit_half(x[:, d // 2:], k, 4))
    return Codebooks(books)


def _coded(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("d").to_numpy()
            for d in np.unique(dims).tolist():
                own = batch.take(pa.array(np.flatnonzero(dims == d)))
                (u, r1), (v, r2) = books.assign(_matrix(own.column("vector"), d))
                names = ["u", "v", "r1", "r2"]
                values = [pa.array(u.astype(np.int32)), pa.array(v.astype(np.int32)), pa.array(r1), pa.array(r2)]
                yield pa.RecordBatch.from_arrays([*own.columns, *values], [*own.schema.names, *names])

    return run


@dataclass(frozen=True)
class Cells:
    """The occupied cells of one dimension: size, anchors, radii, and a number of each."""

    number: np.ndarray  # (centroids, centroids), -1 where no row lies
    rows: np.ndarray
    radii: np.ndarray  # (cells, 2): of a cell
    half_radii: tuple[np.ndarray, np.ndarray]  # of a centroid, over all its cells


def cell_tables(stats: list, books: Codebooks) -> dict[int, Cells]:
    """``stats``: d, u, v, n, r1, r2 of every occupied cell (at most the product of two codebooks a dimension)."""
    by_d: dict[int, list] = {}
    for s in stats:
        by_d.setdefault(s["d"], []).append(s)
    out = {}
    for d, own in by_d.items():
        first, second = books.of(d)
        number = np.full((len(first), len(second)), -1)
        halves = np.zeros(len(first)), np.zeros(len(second))
        for i, s in enumerate(own):
            number[s["u"], s["v"]] = i
            halves[0][s["u"]] = max(halves[0][s["u"]], s["r1"])
            halves[1][s["v"]] = max(halves[1][s["v"]], s["r2"])
        out[d] = Cells(number, np.array([s["n"] for s in own]), np.array([[s["r1"], s["r2"]] for s in own]), halves)
    return out


def falling_cells(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(u, v, bound) in the order of falling ``first[u] + second[v]``; every pair comes once."""
    us, vs = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    a, b = first[us].tolist(), second[vs].tolist()
    heap = [(-(a[0] + b[0]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield us[i], vs[j], -bound
        if j + 1 < len(vs):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(us):
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))


# ---- visits ----


def _visits(books: Codebooks, cells: dict[int, Cells], first_rows: int, rest: bool):
    """Cells of each anchor: the first ones, or those after them whose bound reaches the anchor's ``floor``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("d").to_numpy()
            for d in np.unique(dims).tolist():
                own = batch.take(pa.array(np.flatnonzero(dims == d)))
                x, index = _matrix(own.column("vector"), d), cells[d]
                first, second = books.bounds(x, index.half_radii)
                floors = own.column("floor").to_pylist() if rest else None
                lengths = [np.sqrt((h.astype(float) ** 2).sum(axis=1)) for h in (x[:, :d // 2], x[:, d // 2:])]
                # Scores are whole numbers; bounds are rounded up by more than their error.
                slack = 1e-3 + 1e-9 * own.column("length").to_numpy() * (1 + max(map(np.max, index.half_radii)))
                at, number, parts = [], [], []
                for q in range(len(x)):
                    seen = 0
                    for u, v, bound in falling_cells(first[q], second[q]):
                        c = index.number[u, v]
                        early = seen < first_rows
                        if c >= 0:
                            seen += index.rows[c]
                        if not rest:
                            if not early:
                                break
                        elif floors[q] is not None and bound + slack[q] < floors[q]:
                            break  # certified: no cell from here on reaches the floor
                        elif early or c < 0:
                            continue
                        elif floors[q] is not None:
                            spare = (index.half_radii[0][u] - index.radii[c, 0]) * lengths[0][q] + (
                                index.half_radii[1][v] - index.radii[c, 1]) * lengths[1][q]
                            if bound - spare + slack[q] < floors[q]:
                                continue
                        if c >= 0:
                            at.append(q)
                            number.append(int(u) * len(second[q]) + int(v))
                            parts.append(-(-int(index.rows[c]) // TILE))
                took = own.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*took.columns, pa.array(number, pa.int64()), pa.array(parts, pa.int32())],
                    [*own.schema.names, "cell", "parts"])

    return run


def _pairs(rows: DataFrame, anchors: DataFrame, books: Codebooks, cells: dict[int, Cells], first_rows: int,
           rest: bool) -> DataFrame:
    """Anchors and rows side by side, keyed by (d, block, cell, tile): what ``applyInArrow`` scores."""
    fields = ", ".join(f"{n} {t}" for n, t in anchors.dtypes)
    visits = common.write_table(anchors.mapInArrow(
        _visits(books, cells, first_rows, rest), fields + ", cell long, parts int").withColumn(
        "tile", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"))
    keys = ["d", "block", "cell", "tile"]
    wanted = visits.select(*keys).distinct()
    members = rows.join(wanted, ["d", "cell", "tile"]).withColumn("member", F.lit(True))
    asking = visits.withColumn("member", F.lit(False))
    return members.unionByName(asking, allowMissingColumns=True).select(
        *keys, "member", "row", "id", "label", "length", "vector", *[c for c in anchors.columns if c in ("floor", "windows")])


def _scores(block: np.ndarray, matrix: np.ndarray, largest: float) -> np.ndarray:
    """Exact integer inner products: in doubles while no sum can leave their whole numbers."""
    if largest < 2.0**53:
        return (block.astype(float) @ matrix.T.astype(float)).astype(np.int64)
    return block.astype(np.int64) @ matrix.T.astype(np.int64)


def _scored(keys: tuple, group: pa.Table) -> Iterator[tuple]:
    """(anchor, its scores, candidates' rows, ids and whether they have its label) of one group."""
    d = keys[0].as_py()
    is_member = group.column("member").to_numpy(zero_copy_only=False).astype(bool)
    members, asking = group.filter(pa.array(is_member)), group.filter(pa.array(~is_member))
    if not members.num_rows or not asking.num_rows:
        return
    matrix, asked = _matrix(members.column("vector"), d), _matrix(asking.column("vector"), d)
    largest = members.column("length").to_numpy().max() * asking.column("length").to_numpy().max() + 1
    rows, ids, labels = (members.column(c).to_numpy() for c in ("row", "id", "label"))
    own_rows, own_labels = asking.column("row").to_numpy(), asking.column("label").to_numpy()
    for start in range(0, len(asked), SCORED):
        scores = _scores(asked[start:start + SCORED], matrix, largest)
        for q in range(len(scores)):
            yield (asking, start + q), scores[q], rows, ids, labels == own_labels[start + q], rows != own_rows[start + q]


def _best(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    return at[np.lexsort((rows[at], ids[at], -score[at]))]


_FOUND = "anchor long, slot int, row long, id long, score long"


def _table(found: list[tuple]) -> pa.Table:
    columns = [np.concatenate([np.broadcast_to(np.asarray(f[i]), len(f[2])) for f in found]) if found else np.zeros(0)
               for i in range(5)]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return pa.table([pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, types)],
                    names=["anchor", "slot", "row", "id", "score"])


def _positives(k: int):
    def run(keys: tuple, group: pa.Table) -> pa.Table:
        found = []
        for (asking, q), score, rows, ids, same, other in _scored(keys, group):
            floor = asking.column("floor")[q].as_py() if "floor" in asking.column_names else None
            ok = same & other if floor is None else same & other & (score >= floor)
            at = np.flatnonzero(ok)
            if len(at) > k:  # ties of the k-th score stay until ids decide
                at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
            best = _best(score, ids, rows, at)[:k]
            found.append((asking.column("row")[q].as_py(), 0, rows[best], ids[best], score[best]))
        return _table(found)

    return run


def _negatives(k: int):
    def run(keys: tuple, group: pa.Table) -> pa.Table:
        found = []
        for (asking, q), score, rows, ids, same, _ in _scored(keys, group):
            windows = asking.column("windows")[q].as_py()
            low, high = min(w["low"] for w in windows), max(w["high"] for w in windows)
            at = _best(score, ids, rows, np.flatnonzero(~same & (score >= low) & (score <= high)))
            for w in windows:
                best = at[(score[at] >= w["low"]) & (score[at] <= w["high"])][:k]
                found.append((asking.column("row")[q].as_py(), w["slot"], rows[best], ids[best], score[best]))
        return _table(found)

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: Column, scale: float = 256.0, positives: int = 5, negatives: int = 3,
         low_percent: int = 50, high_percent: int = 95, cell_rows: int = CELL_ROWS, first_rows: int = FIRST_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every anchor and positive.

    ``vectors`` has vec_id, embedding and label. Components become floor(scale * x); scores are integer
    inner products, higher first, ties to the smaller vec_id. An anchor (where ``anchors`` holds) has the
    first ``positives`` other rows of its label as positives, and for each of them the first ``negatives``
    rows of other labels with a score of ``low_percent`` to ``high_percent`` hundredths of the positive's.
    The result is exact for any codebooks.

    No part take rows with a null vec_id, label, vector or component, with a non-finite one, or so long
    that a score might not fit a long (a square of 2**62). Only vectors of one dimension meet; zero and
    empty vectors score 0. Rows that repeat a vec_id are rows of their own. Other columns are ignored.
    """
    usable = common.write_table(vectors.where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("id"),
        F.col("label").cast("long").alias("label"), F.col("embedding").alias("v"),
        F.coalesce(anchors, F.lit(False)).alias("asks")).mapInArrow(_integers(scale), _ROW))
    n = usable.count()
    books = fit(usable, n, cell_rows)
    rows = common.write_table(usable.mapInArrow(_coded(books), _ROW + ", u int, v int, r1 double, r2 double"))
    # At most the product of two codebooks for each dimension, whatever the number of rows.
    stats = rows.groupBy("d", "u", "v").agg(
        F.count(F.lit(1)).alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2"),
        F.count_if("asks").alias("anchors")).orderBy("d", "u", "v").collect()
    cells = cell_tables(stats, books)
    spark, shift, before = vectors.sparkSession, [], 0
    for s in stats:
        shift.append((s["d"], s["u"], s["v"], s["u"] * len(books.of(s["d"])[1]) + s["v"], -(-s["n"] // TILE), before, s["anchors"]))
        before += s["anchors"]
    places = F.broadcast(spark.createDataFrame(shift, "d int, u int, v int, cell long, parts int, before long, anchors long"))
    known = rows.join(places, ["d", "u", "v"]).withColumn("dealt", F.xxhash64("row"))
    tiles = known.select("d", "cell", F.pmod("dealt", F.col("parts")).cast("int").alias("tile"), "row", "id", "label",
                         "length", "vector")
    # Anchors of near cells come into one block.
    asking = common.write_table(known.where("asks").select(
        "row", "id", "label", "d", "length", "vector",
        F.floor((F.col("before") + F.pmod("dealt", F.col("anchors"))) / BLOCK).alias("block")))

    def visit(who: DataFrame, how, rest: bool) -> DataFrame:
        pairs = _pairs(tiles, who, books, cells, first_rows * max(positives, negatives), rest)
        return pairs.groupBy("d", "block", "cell", "tile").applyInArrow(how, _FOUND)

    early = common.write_table(_first(visit(asking, _positives(positives), False), positives))
    floors = early.where(F.col("rank") == positives).select(F.col("anchor").alias("row"), F.col("score").alias("floor"))
    late = visit(asking.join(floors, "row", "left"), _positives(positives), True)
    chosen = common.write_table(_first(early.drop("rank").unionByName(late), positives))

    low = F.ceil(F.col("score") * low_percent / F.lit(100)).cast("long")
    high = F.floor(F.col("score") * high_percent / F.lit(100)).cast("long")
    windows = chosen.select("anchor", F.col("rank").alias("slot"), low.alias("low"), high.alias("high")).where("low <= high")

    def with_windows(table: DataFrame) -> DataFrame:
        grouped = table.groupBy(F.col("anchor").alias("row")).agg(
            F.collect_list(F.struct("slot", "low", "high")).alias("windows"), F.min("low").alias("floor"))
        return asking.join(grouped, "row")

    early = common.write_table(_first(visit(with_windows(windows), _negatives(negatives), False), negatives))
    full = early.where(F.col("rank") == negatives).select("anchor", "slot", F.col("score").alias("low"))
    narrowed = windows.withColumnRenamed("low", "least").join(full, ["anchor", "slot"], "left").select(
        "anchor", "slot", F.coalesce("low", "least").alias("low"), "high")
    late = visit(with_windows(narrowed), _negatives(negatives), True)
    mined = _first(early.drop("rank").unionByName(late), negatives).select(
        "anchor", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = chosen.select("anchor", F.col("rank").alias("slot"), F.col("id").alias("positive_id"),
                          F.col("score").alias("positive_score"))
    names = asking.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return mined.join(pairs, ["anchor", "slot"]).join(names, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
