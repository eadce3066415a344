"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A hash is the signed axis nearest to the rotated vector. Every vector is kept in its own bucket
of each table and in the next likely ones (multiprobe); vectors that meet in a bucket are compared
exactly. Large buckets are cut into tiles of bounded size. A pair that meets in several buckets
counts in the first of them only, so no pair leaves a task: tasks return numbers of links and
local components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trailcast.llm import common
from trailcast.llm.components import components
from trailcast.llm.vectors import by_dimension, hadamard, unit

#: Chance, at the threshold, that two vectors share no bucket of any table.
MISS = 1e-5
#: Buckets of a table that hold a vector: its own and the next likely ones.
PROBES = 3
#: Vectors of a bucket, about, that the number of hashes of a key aims at.
AIM = 96
#: Vectors of one side of a tile.
TILE = 1024
#: Bucket entries that one task compares, about.
PER_GROUP = 8192


def collision_rate(cosine: float, width: int, per_key: int, rounds: int = 2000) -> float:
    """Share of vector pairs with this cosine that share a bucket of one table (simulated)."""
    rng = np.random.default_rng(7)
    a = unit(rng.standard_normal((rounds, width)))
    b = rng.standard_normal((rounds, width))
    b -= np.einsum("ij,ij->i", a, b)[:, None] * a
    b = cosine * a + math.sqrt(1 - cosine**2) * unit(b)
    x, y = (_axes(v, _rotations(per_key, width), per_key)[:, 0] for v in (a, b))
    return float((x[:, :, None] == y[:, None, :]).any(axis=(1, 2)).mean())


def _axes(matrix: np.ndarray, signs: np.ndarray, per_key: int) -> np.ndarray:
    """Bucket codes (rows, tables, PROBES): signed axes of the rotated vectors, ``per_key`` to a key."""
    n, width = matrix.shape
    tables = len(signs) // per_key
    out = np.empty((n, tables, PROBES), np.int64)
    for t in range(tables):
        best = np.empty((n, per_key), np.int64)
        next_axis = np.empty((n, per_key, PROBES - 1), np.int64)
        gap = np.empty((n, per_key, PROBES - 1))
        for k in range(per_key):
            turned = matrix
            for s in signs[t * per_key + k]:
                turned = hadamard(turned * s) / math.sqrt(width)
            size = np.abs(turned)
            top = np.argsort(-size, axis=1, kind="stable")[:, :PROBES]
            code = top * 2 + (np.take_along_axis(turned, top, axis=1) < 0)
            if code.shape[1] < PROBES:
                code = np.pad(code, ((0, 0), (0, PROBES - code.shape[1])), mode="edge")
                top = np.pad(top, ((0, 0), (0, PROBES - top.shape[1])), mode="edge")
            best[:, k] = code[:, 0]
            next_axis[:, k] = code[:, 1:]
            level = np.take_along_axis(size, top, axis=1)
            gap[:, k] = level[:, :1] - level[:, 1:]
        power = (2 * width) ** np.arange(per_key)
        own = (best * power).sum(axis=1)
        out[:, t, 0] = own
        # The likeliest neighbours change one hash to an axis of nearly the same size.
        changed = own[:, None, None] + (next_axis - best[:, :, None]) * power[None, :, None]
        order = np.argsort(gap.reshape(n, -1), axis=1, kind="stable")[:, :PROBES - 1]
        out[:, t, 1:] = np.take_along_axis(changed.reshape(n, -1), order, axis=1)
    return out


def _rotations(count: int, width: int) -> np.ndarray:
    return np.random.default_rng(20_011).choice([-1.0, 1.0], size=(count, 3, width))


def plan(largest_group: int, width: int, cosine: float) -> tuple[int, int]:
    """Hashes of a key and tables: keys get longer with the largest group, tables with the keys."""
    per_key = max(1, round(math.log(max(1.0, largest_group / AIM), 2 * width)))
    rate = collision_rate(cosine, width, per_key)
    return per_key, max(1, math.ceil(math.log(MISS) / math.log(1 - min(rate, 0.999))))


def _keys(cosine: float, largest: int):
    made: dict[int, tuple[np.ndarray, int]] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                rows = part.column(0).to_numpy(zero_copy_only=False)
                labels = part.column(1).to_numpy(zero_copy_only=False)
                for at, matrix in by_dimension(part.column(2)):
                    d = matrix.shape[1]
                    if d not in made:
                        width = max(2, 1 << (d - 1).bit_length())
                        per_key, tables = plan(largest, width, cosine)
                        made[d] = _rotations(per_key * tables, width), per_key
                    signs, per_key = made[d]
                    matrix = unit(matrix)
                    wide = np.zeros((len(at), signs.shape[2]))
                    wide[:, :d] = matrix
                    codes = _axes(wide, signs, per_key).astype(np.uint64)
                    salt = np.arange(codes.shape[1], dtype=np.uint64)[None, :, None] + np.uint64(d << 20)
                    keys = common.mix(common.mix(codes + common.mix(salt)) + labels[at].astype(np.int64).view(np.uint64)[:, None, None])
                    keys = np.sort(keys.reshape(len(at), -1).view(np.int64), axis=1)
                    vectors = [row.tobytes() for row in matrix]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[at]), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), keys.shape[1]).cast(
                            pa.list_(pa.int64())), pa.array(vectors, pa.binary())], ["row", "keys", "vector"])

    return run


def _compare(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        row = table.column("row").to_numpy()
        key, low, high, side = (table.column(c).to_numpy() for c in ("key", "low", "high", "side"))
        order = np.lexsort((row, high, low, key))
        changed = np.any([c[order][1:] != c[order][:-1] for c in (key, low, high)], axis=0)
        edges = np.append(np.flatnonzero(np.append(True, changed)), len(order))
        vectors, keys = table.column("vector").to_pylist(), table.column("keys").combine_chunks()
        all_keys = [k.values.to_numpy(zero_copy_only=False) for k in keys]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in zip(edges[:-1], edges[1:]):
            these = order[a:b]
            if len(these) < 2:
                continue
            matrix = np.stack([np.frombuffer(vectors[i]) for i in these])
            linked = matrix @ matrix.T >= cosine
            np.fill_diagonal(linked, False)
            if low[these[0]] != high[these[0]]:  # a tile across two parts of a bucket
                linked &= side[these][:, None] != side[these][None, :]
            near = np.flatnonzero(linked.any(axis=1))
            if not len(near):
                continue
            linked = linked[np.ix_(near, near)]
            name = np.arange(len(near))
            while True:
                least = np.minimum(name, np.where(linked, name[None, :], len(near)).min(axis=1))
                least = least[least]
                if (least == name).all():
                    break
                name = least
            first = linked.copy()
            here = key[these[0]]
            earlier: dict[int, list[int]] = {}
            for k, i in enumerate(near):
                own = all_keys[these[i]]
                for x in set(own[own < here].tolist()):
                    earlier.setdefault(x, []).append(k)
            for members in earlier.values():
                if len(members) > 1:
                    first[np.ix_(members, members)] = False
            rows = row[these[near]]
            out.append((rows, first.sum(axis=1), rows[name]))
        if not out:
            return pa.table({"row": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "head": pa.array([], pa.int64())})
        return pa.table({c: pa.array(np.concatenate([o[k] for o in out]), pa.int64())
                         for k, c in enumerate(("row", "n", "head"))})

    return run


def link(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """Every row of (vec_id, embedding, label) with n_links, component_id and kept.

    Vectors of equal label and dimension link when their cosine, in double precision, is at least
    ``cosine``. ``component_id`` is the smallest vec_id reachable by links; ``kept`` says whether it
    is the row's own. Null, zero and non-finite vectors, vectors with null components and rows without
    a label link with nothing. Repeated rows are vectors of their own and link with each other. A null
    vec_id is never the smallest unless it stands alone, then kept is true. Other input columns pass
    through; those called like the new ones are replaced.
    """
    names = [c for c in vectors.columns if c not in ("n_links", "component_id", "kept")]
    rows = common.write_table(common.with_row_id(vectors.select(F.struct(*names).alias("_in")), "row"))
    usable = rows.select("row", F.col("_in.label").cast("long").alias("label"), F.col("_in.embedding").alias("v")).where(
        "label is not null")
    largest = usable.groupBy("label").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    keyed = common.write_table(usable.mapInArrow(_keys(cosine, largest), "row long, keys array<long>, vector binary"))
    entries = keyed.select("row", "keys", "vector", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    parts = F.ceil(F.col("size") / F.lit(TILE)).cast("int")
    tiles = entries.join(sizes, "key").withColumn("parts", parts).withColumn(
        "own", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = tiles.select("row", "keys", "vector", "key", F.least("own", "other").alias("low"),
                         F.greatest("own", "other").alias("high"), F.col("own").alias("side"))
    total = keyed.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    groups = common.tasks(rows.sparkSession, total, PER_GROUP)
    found = common.write_table(tiles.groupBy(F.pmod(F.xxhash64("key", "low", "high"), F.lit(groups)).alias("part"))
                               .applyInArrow(_compare(cosine), "row long, n long, head long"))
    degree = found.groupBy("row").agg(F.sum("n").alias("n"))
    named = components(found.select("row", "head"), "row", "head")
    out = rows.join(degree, "row", "left").join(named.withColumnRenamed("node", "row"), "row", "left")
    out = common.write_table(out.withColumn("group", F.coalesce("component", "row")).drop("component"))
    least = out.groupBy("group").agg(F.min("_in.vec_id").alias("component_id"))
    own = F.col("_in.vec_id").eqNullSafe(F.col("component_id"))
    return out.join(least, "group").select(
        "_in.*", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), "component_id", own.alias("kept"))
