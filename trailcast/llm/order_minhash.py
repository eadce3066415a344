"""Near-duplicate documents by order min-hash, verified by banded alignment.

Texts with the same words collapse first. Each remaining text has sketches, as many as the miss
chance at the least similarity asks for: the two smallest occurrence-labelled k-mers (words) under one hash, in text order. Texts that share a
sketch meet the smallest row of that bucket, and then all rows of it that are not yet in their
class; candidate pairs are aligned in numpy, many at a time, in a band that widens up
to the largest distance that still counts. Linked texts form classes.

Strangers over one passage fill a bucket without a link. Rows of large buckets therefore do not meet
there but by their rarest pairs of words: similar texts share so many pairs that the first ones in any
common order must meet (a prefix filter, exact), and with rare ones first a shared passage comes last. How
rare a pair is is read from a bounded table of hashed counts: a pair that shares its counter only comes later.
Bags of words rule out most other pairs before one is written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from trailcast.llm import common
from trailcast.llm.components import components

#: Least similarity (1 - word edit distance / longer length) of a link.
SIMILARITY = 0.8
#: Chance that two texts of that similarity share no sketch, if single words differ at random places.
MISS = 1e-5
#: Words of a k-mer; shorter k-mers that texts of fewer words than given get besides, as an edit spoils most longer ones.
KMER, SHORTER = 3, ((2, 64), (1, 12))


def sketch_count(size: int) -> int:
    """Sketches of k-mers of ``size`` words that keep the miss chance: both k-mers of a sketch have to agree."""
    kept = SIMILARITY ** size
    return math.ceil(math.log(MISS) / math.log1p(-(kept / (2 - kept)) ** 2))


#: First width of the alignment band (cells to either side); it doubles up to the limit.
BAND = 8
#: Words of the pairs that are aligned at once.
ALIGN_WORDS = 1 << 18
#: Rows of a bucket that meet in one tile, about; rows of a bucket beyond which they meet by rare word pairs.
TILE, LARGE = 256, 64
#: Hash buckets of the bags that rule pairs out; rows that an Arrow function gets at once if they hold texts or tiles.
BAG, TEXTS, TILES = 512, 256, 32

#: Parts in which the sketches are grouped, one after another, and in which at most entries with bags of more bytes than given
#: meet: what lies on disk at once.
PASSES, MEETING_BYTES = 4, 1 << 26
#: Bits of a bitmap that thins texts before they are joined, at most (2**20 narrow rows are broadcast).
MOST_BITS = 1 << 26
#: Counters of word pairs, as a power of two: one byte each, at most 32 MB are broadcast; counters that one task sums.
MOST_COUNTERS, COUNTERS = 25, 20

_SEEDS = common.mix(np.arange(1, sketch_count(KMER) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def labelled_kmers(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each k-mer with the number of its earlier occurrences in the text."""
    kmers, _ = common.window_hashes(words, np.array([0, len(words)]), min(size, len(words)), 0)
    order = np.argsort(kmers, kind="stable")
    sorted_kmers = kmers[order]
    first = np.append(True, sorted_kmers[1:] != sorted_kmers[:-1])
    start = np.flatnonzero(first)
    occurrence = np.empty(len(kmers), np.uint64)
    occurrence[order] = (np.arange(len(kmers)) - np.repeat(start, np.diff(np.append(start, len(kmers))))).astype(np.uint64)
    return common.mix(kmers + occurrence * np.uint64(0xC2B2AE3D27D4EB4F))


def sketches(kmers: np.ndarray, count: int) -> np.ndarray:
    """One 64-bit value a sketch: the two smallest k-mers in text order (the only one, if there is one)."""
    out = np.empty(count, np.uint64)
    step = max(1, (1 << 16) // max(1, len(kmers)))
    for a in range(0, count, step):
        seeds = _SEEDS[a:min(a + step, count)]
        value = kmers[None, :] * seeds[:, None]
        value ^= value >> np.uint64(31)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        value = value.view(np.int64)
        rows = np.arange(len(seeds))
        one = value.argmin(axis=1)
        if len(kmers) > 1:
            value[rows, one] = np.iinfo(np.int64).max
            two = value.argmin(axis=1)
        else:
            two = one
        early, late = np.minimum(one, two), np.maximum(one, two)
        out[a:a + step] = common.mix(kmers[early] * np.uint64(3) + common.mix(kmers[late] + seeds))
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        data, offsets = common.buffers(batch.column(1))
        for start, end in common.pieces(offsets):
            part = data[offsets[start]:offsets[end]]
            starts, ends, bounds = common.word_bounds(part, offsets[start:end + 1] - offsets[start])
            hashes = common.word_hashes(part, starts, ends)
            rows, keys, lengths = [], [], []
            for k in range(end - start):
                words = hashes[bounds[k]:bounds[k + 1]]
                if not len(words):
                    continue
                sizes = [KMER, *(size for size, below in SHORTER if len(words) < below)]
                found = [sketches(labelled_kmers(words, size), sketch_count(size)) for size in sizes]
                rows.append(ids[start + k])
                lengths.append(len(words))
                keys.append(np.concatenate(found).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(lengths, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()),
                                          pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))],
                ["row", "n", "keys"])


def distances(left: list[np.ndarray], right: list[np.ndarray], limits: np.ndarray) -> np.ndarray:
    """Edit distance of each pair of word sequences; limit + 1 where it is larger than the limit.

    Banded alignment, all pairs of a call side by side: row i holds the cells j - i in the band.
    """
    out = limits + 1
    lengths = np.array([(len(a), len(b)) for a, b in zip(left, right)]).reshape(-1, 2)
    todo = np.flatnonzero(np.abs(lengths[:, 0] - lengths[:, 1]) <= limits)
    band = BAND
    while len(todo):
        todo = todo[np.argsort(lengths[todo, 0], kind="stable")]
        again = []
        at = 0
        while at < len(todo):
            end = at + 1
            while end < len(todo) and (end + 1 - at) * (lengths[todo[end], 0] + 2 * band) <= ALIGN_WORDS:
                end += 1
            these = todo[at:end]
            found = _banded([left[i] for i in these], [right[i] for i in these], band, np.minimum(limits[these], band))
            done = (found <= band) | (band >= limits[these])
            out[these[done]] = np.minimum(found[done], limits[these[done]] + 1)
            again.append(these[~done])
            at = end
        todo = np.concatenate(again)
        band *= 4
    return out


def _banded(left: list[np.ndarray], right: list[np.ndarray], band: int, limits: np.ndarray) -> np.ndarray:
    pairs, width = len(left), 2 * band + 1
    rows = max((len(a) for a in left), default=0)
    far = np.int32(1 << 29)
    a = np.zeros((rows, pairs), np.uint64)
    b = np.full((pairs, rows + width + 1), np.uint64(1), np.uint64)
    for k in range(pairs):
        a[:len(left[k]), k] = left[k] | np.uint64(1)
        tail = right[k][:rows + band + 1]
        b[k, band:band + len(tail)] = tail | np.uint64(1)
    b[:, :band] = 0  # cells before the first word of the right text match nothing
    n, m = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    shift = np.arange(-band, band + 1, dtype=np.int32)
    cells = np.where(shift >= 0, shift, far)[None, :].repeat(pairs, axis=0).astype(np.int32)
    out = np.full(pairs, int(far))
    inside = np.abs(m - n) <= band
    live = np.arange(pairs)
    ended = np.flatnonzero(inside & (n == 0))
    out[ended] = m[ended]
    for i in range(1, rows + 1):
        better = cells + (b[:, i - 1:i - 1 + width] != a[i - 1][:, None])
        np.minimum(better[:, :-1], cells[:, 1:] + 1, out=better[:, :-1])
        if i <= band:
            better[:, :band - i] = far
            better[:, band - i] = i
        better -= shift
        np.minimum.accumulate(better, axis=1, out=better)
        better += shift
        cells = better
        ended = np.flatnonzero((n == i) & inside)
        if len(ended):
            out[live[ended]] = cells[ended, band + m[ended] - n[ended]]
        if i % 32 == 0:
            stay = (n > i) & (cells.min(axis=1) <= limits) & inside
            if not stay.all():
                cells, b, live, limits, n, m, inside = cells[stay], b[stay], live[stay], limits[stay], n[stay], m[stay], inside[stay]
                a = a[:, stay]
                if not len(live):
                    break
    return out


def allowed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Largest word edit distance at which two texts of n and m words are similar."""
    return np.floor(np.maximum(n, m) * (1 - SIMILARITY) + 1e-9).astype(np.int64)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, text_a, text_b) to links (a, b, distance)."""
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            sides = []
            for column in (2, 3):
                data, offsets = common.buffers(part.column(column))
                starts, ends, bounds = common.word_bounds(data, offsets)
                hashes = common.word_hashes(data, starts, ends)
                sides.append([hashes[x:y] for x, y in zip(bounds[:-1], bounds[1:])])
            n, m = (np.array([len(x) for x in side]) for side in sides)
            limits = allowed(n, m)
            # A bag of common words bounds the distance from below.
            lower = np.array([max(len(x), len(y)) - _common(x, y) for x, y in zip(*sides)])
            todo = np.flatnonzero(lower <= limits)
            found = distances([sides[0][k] for k in todo], [sides[1][k] for k in todo], limits[todo])
            good = todo[found <= limits[todo]]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(good)), part.column(1).take(pa.array(good)),
                 pa.array(found[found <= limits[todo]], pa.int64())], ["a", "b", "distance"])


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Number of words that two bags have in common."""
    both = np.concatenate([x, y])
    side = np.append(np.ones(len(x), np.int64), np.full(len(y), -1))
    order = np.argsort(both, kind="stable")
    both, side = both[order], side[order]
    start = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
    return (len(x) + len(y) - int(np.abs(np.add.reduceat(side, start)).sum())) // 2 if len(start) else 0


def _bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words of each text (row, text) fall into each of BAG hash buckets; null where a count could overflow."""
    for batch in batches:
        data, offsets = common.buffers(batch.column(1))
        bags: list[bytes | None] = []
        for start, end in common.pieces(offsets):
            part = data[offsets[start]:offsets[end]]
            starts, ends, bounds = common.word_bounds(part, offsets[start:end + 1] - offsets[start])
            places = (common.word_hashes(part, starts, ends) % np.uint64(BAG)).astype(np.int64)
            for x, y in zip(bounds[:-1], bounds[1:]):
                bags.append(np.bincount(places[x:y], minlength=BAG).astype(np.uint16).tobytes() if y - x < 1 << 16 else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bags, pa.binary())], ["row", "bag"])


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, bag_a, bag_b) whose bags do not already rule a link out: words in common are at most those of the bags."""
    for batch in batches:
        good = np.ones(batch.num_rows, bool)
        left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        known = np.array([x is not None and y is not None for x, y in zip(left, right)], bool)
        at = np.flatnonzero(known)
        if len(at):
            x, y = (np.frombuffer(b"".join(side[k] for k in at), np.uint16).reshape(-1, BAG) for side in (left, right))
            n, m = x.sum(axis=1, dtype=np.int64), y.sum(axis=1, dtype=np.int64)
            good[at] = np.maximum(n, m) - np.minimum(x, y).sum(axis=1, dtype=np.int64) <= allowed(n, m)
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(good)) for k in (0, 1)], ["a", "b"])


def _across(best: bool):
    """Tiles (left, right: lists of row, n, component, bag; right null for a block with itself) to pairs of
    unlike components that neither lengths nor bags rule out: all, or the likeliest for each two components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                alone = not batch.column(1)[k].is_valid
                one = _block(batch.column(0), k)
                two = one if alone else _block(batch.column(1), k)
                n, m = one[1][:, None], two[1][None, :]
                limit = allowed(n, m)
                good = (one[2][:, None] != two[2][None, :]) & (np.abs(n - m) <= limit)
                if alone:
                    good = np.triu(good, 1)
                i, j = np.nonzero(good)
                least = np.empty(len(i), np.int64)
                for start in range(0, len(i), 1 << 14):
                    x, y = i[start:start + (1 << 14)], j[start:start + (1 << 14)]
                    both = np.minimum(one[3][x], two[3][y]).sum(axis=1, dtype=np.int64)
                    least[start:start + (1 << 14)] = np.maximum(one[1][x], two[1][y]) - both
                unknown = ~(one[4][i] & two[4][j])
                ok = unknown | (least <= limit[i, j])
                i, j, least = i[ok], j[ok], least[ok]
                if best and len(i):
                    c, d = one[2][i], two[2][j]
                    order = np.lexsort((least, np.maximum(c, d), np.minimum(c, d)))
                    c, d = np.minimum(c, d)[order], np.maximum(c, d)[order]
                    first = np.append(True, (c[1:] != c[:-1]) | (d[1:] != d[:-1]))
                    i, j = i[order[first]], j[order[first]]
                if len(i):
                    a, b = one[0][i], two[0][j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _block(column: pa.Array, k: int) -> tuple[np.ndarray, ...]:
    """Rows, word counts, components, bags, and whether the bags are known."""
    own = column[k].values
    row, n, component = (own.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in range(3))
    bags = own.field(3).to_pylist()
    known = np.array([x is not None for x in bags], bool)
    return row, n, component, np.frombuffer(b"".join(x or bytes(2 * BAG) for x in bags), np.uint16).reshape(-1, BAG), known


def _pairs_of_words(texts: pa.Array) -> Iterator[np.ndarray]:
    """The occurrence-labelled pairs of adjacent words of each text."""
    data, offsets = common.buffers(texts)
    for start, end in common.pieces(offsets):
        part = data[offsets[start]:offsets[end]]
        starts, ends, bounds = common.word_bounds(part, offsets[start:end + 1] - offsets[start])
        hashes = common.word_hashes(part, starts, ends)
        for x, y in zip(bounds[:-1], bounds[1:]):
            yield labelled_kmers(hashes[x:y], 2) if y - x > 1 else np.zeros(0, np.uint64)


def shared_pairs(n: int) -> int:
    """Pairs of adjacent words that a text of n words has in common with every similar text, at least: a text of N
    words within the distance d keeps N - 1 - 2 d of the pairs, and N - 1 - 2 d grows from N to N + 5."""
    lengths = np.arange(n, n + 6)
    return int((lengths - 1 - 2 * allowed(lengths, lengths)).min())


def _counted(bits: int):
    """(row, text) to the counters of the word pairs, by parts of the table of counters."""
    own = min(bits, COUNTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.sort(np.concatenate([np.zeros(0, np.uint64), *_pairs_of_words(batch.column(1))]) >> np.uint64(64 - bits))
            piece = (at >> np.uint64(own)).astype(np.int64)
            edges = np.append(np.flatnonzero(np.append(True, piece[1:] != piece[:-1])), len(at)) if len(at) else np.zeros(1, np.int64)
            at = (at & np.uint64((1 << own) - 1)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece[edges[:-1]]), pa.array([at[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())],
                ["part", "counters"])

    return run


def _levels(bits: int):
    """One part of the counters: 0 below two, else eight times the binary logarithm."""
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << min(bits, COUNTERS), np.int64)
        for batch in batches:
            for payload in batch.column("counters").to_pylist():
                at, times = np.unique(np.frombuffer(payload, np.uint32), return_counts=True)
                counts[at] += times
        levels = np.minimum(255, 8 * np.log2(np.maximum(counts, 1))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([levels.tobytes()], pa.binary())], ["part", "levels"])

    return run


def _rarest(bits: int, shared):
    """(row, text) to (row, key): the rarest pairs of each text, as many as similar texts need to meet in one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch in batches:
            keys = []
            for grams in _pairs_of_words(batch.column(1)):
                level = levels[grams >> np.uint64(64 - bits)]
                first = np.lexsort((grams, level))[:len(grams) - shared_pairs(len(grams) + 1) + 1] if len(grams) else np.zeros(0, np.int64)
                # Pairs that occur once rank first but meet nobody.
                keys.append(grams[first[level[first] > 0]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), [len(k) for k in keys])),
                 pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64))], ["row", "key"])

    return run


def _rare_keys(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, key): the rarest word pairs of each of ``rows`` (row, n), as many as similar texts need to meet in one."""
    spark = texts.sparkSession
    chosen = common.write_table(_named(texts, rows.select("row")))
    words = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(6, min(MOST_COUNTERS, int(2 * words).bit_length()))
    parts = common.write_table(common.write_table(chosen.mapInArrow(_counted(bits), "part long, counters binary"), TEXTS).groupBy(
        "part").applyInArrow(_levels(bits), "part long, levels binary"))
    levels, size = np.zeros(1 << bits, np.uint8), 1 << min(bits, COUNTERS)
    for r in parts.toLocalIterator():  # at most 2**MOST_COUNTERS bytes in all
        levels[r["part"] * size:(r["part"] + 1) * size] = np.frombuffer(r["levels"], np.uint8)
    shared = spark.sparkContext.broadcast(levels)
    keys = common.write_table(chosen.mapInArrow(_rarest(bits, shared), "row long, key long"), TEXTS)
    shared.unpersist()
    return keys


def _bitmap(ids: DataFrame) -> tuple[DataFrame, Column]:
    """Words of a bitmap of the rows in a written table ``ids``, and whether a row's bit is set: for all of them, few others."""
    bits = max(64, min(MOST_BITS, 1 << (8 * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64("row"), F.lit(bits))
    words = common.write_table(ids.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("set")))
    return F.broadcast(words), (F.shiftright(place, 6) == F.col("word")) & (F.getbit(F.col("set"), place.bitwiseAND(63).cast("int")) == 1)


def _named(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of ``rows`` that ``ids`` (row) names. A bitmap comes first, so that hardly any other text is shuffled."""
    ids = common.write_table(ids)
    words, may = _bitmap(ids)
    return rows.join(words, may, "left_semi").join(ids, "row", "left_semi")


def _verified(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links of candidate pairs. Bags rule out most strangers first; texts move only once they take part in a pair."""
    start = common.mark()
    pairs = common.write_table(pairs)
    named = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    bags = common.write_table(_named(rows, named).mapInArrow(_bag, "row long, bag binary"), TEXTS)
    pairs = common.write_table(pairs.join(bags.toDF("a", "bag_a"), "a").join(bags.toDF("b", "bag_b"), "b").select(
        "a", "b", "bag_a", "bag_b").mapInArrow(_plausible, "a long, b long"))
    found = _aligned(rows, pairs)
    common.drop_since(rows.sparkSession, start, 1)
    return found


def _aligned(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    start = common.mark()
    named = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    texts = common.write_table(_named(rows, named))
    left = texts.select(F.col("row").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("row").alias("b"), F.col("text").alias("text_b"))
    found = common.write_table(pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(
        _verify, "a long, b long, distance long"), TEXTS)
    common.drop_since(rows.sparkSession, start, 1)
    return found


def _meetings(entries: DataFrame, bags: DataFrame, component: DataFrame, best: bool) -> DataFrame:
    """Pairs of rows of unlike components that share a key of ``entries`` (key, row, n), by tiles.

    Bags join only those entries whose key has several components.
    """
    member = entries.join(component.withColumnRenamed("node", "row"), "row", "left").withColumn(
        "component", F.coalesce("component", "row"))
    mixed = member.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                      F.count(F.lit(1)).alias("size")).where("low < high").select("key", "size")
    open_ = common.write_table(member.join(mixed, "key"))
    # Each entry carries a bag, so many entries meet in parts, one after another.
    parts, found = min(PASSES, 1 + open_.count() * 2 * BAG // MEETING_BYTES), []
    for k in range(parts):
        blocks = open_.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == k).join(bags, "row").withColumn("blocks", F.ceil(F.col("size") / TILE)).withColumn(
            "block", F.pmod(F.xxhash64("row"), F.col("blocks"))).groupBy("key", "blocks", "block").agg(
            F.collect_list(F.struct("row", "n", "component", "bag")).alias("part"))
        alone = blocks.where("blocks = 1").select(F.col("part").alias("left"), F.lit(None).cast(blocks.schema["part"].dataType).alias("right"))
        # Each block meets itself and every later block of its key.
        cut = blocks.where("blocks > 1").select("key", "block", "part", F.explode(F.expr(
            "transform(sequence(0L, blocks - 1), x -> named_struct('low', least(x, block), 'high', greatest(x, block)))")).alias("at"))
        tiles = cut.groupBy("key", "at").agg(
            F.first(F.when(F.col("block") == F.col("at.low"), F.col("part")), ignorenulls=True).alias("left"),
            F.first(F.when((F.col("block") == F.col("at.high")) & (F.col("at.low") < F.col("at.high")), F.col("part")), ignorenulls=True).alias("right"))
        tiles = tiles.where("left is not null and (right is not null or at.low = at.high)").select("left", "right")
        found.append(common.write_table(alone.unionByName(tiles).mapInArrow(_across(best), "a long, b long").distinct(), TILES))
    return found[0] if parts == 1 else common.write_table(reduce(DataFrame.unionByName, found).distinct())


def links(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Verified links (a < b, distance) between those rows of (row, text) that ``heads`` (row) names, enough for their classes.

    Every row is compared with the smallest row of each of its buckets. What these links leave
    apart in a bucket is then compared row by row: pairs are left out only if they are in one class
    already, or if lengths or bags of words rule a link out. First the likeliest pair of each two
    classes of a tile is aligned, then what still lies in two classes. Buckets of more than LARGE rows
    are replaced by the rarest word pairs of their rows, which any two similar texts share.
    """
    spark = rows.sparkSession
    start = common.mark()
    keyed = rows.mapInArrow(_sketch, "row long, n int, keys array<long>")
    keyed = common.write_table(keyed.join(heads, "row", "left_semi"))
    parts = []
    for k in range(PASSES):  # a text has many more sketches
        at = common.mark()
        keys = keyed.select("row", "n", F.explode(F.expr(
            f"transform(sequence({k}, size(keys) - 1, {PASSES}), i -> xxhash64(i, keys[i]))")).alias("key"))
        first = common.write_table(keys.groupBy("key").agg(
            F.min("row").alias("head"), F.min_by("n", "row").alias("head_n"), F.count(F.lit(1)).alias("size")).where("size > 1"))
        parts.append(common.write_table(keys.join(first, "key")))
        common.drop_since(spark, at, 1)
    shared = reduce(DataFrame.unionByName, parts)
    near = (F.col("row") != F.col("head")) & (
        F.abs(F.col("n") - F.col("head_n")) <= F.floor(F.greatest("n", "head_n") * F.lit(1 - SIMILARITY) + 1e-9))
    linked = _verified(rows, shared.where(near).select(F.col("head").alias("a"), F.col("row").alias("b")).distinct())
    component = common.write_table(components(linked))

    # What is left: buckets with rows of several components.
    member = shared.select("key", "row", "n", "size").join(component.withColumnRenamed("node", "row"), "row", "left").withColumn(
        "component", F.coalesce("component", "row"))
    mixed = member.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    left = common.write_table(member.join(mixed, "key").select("key", "row", "n", "size"))
    names = common.write_table(left.groupBy("row").agg(F.first("n").alias("n"), F.max("size").alias("most")))
    bags = common.write_table(_named(rows, names.select("row")).mapInArrow(_bag, "row long, bag binary"), TEXTS)
    rare = _rare_keys(rows, names.where(F.col("most") > LARGE)).withColumn("kind", F.lit(1))
    meeting = left.where(F.col("size") <= LARGE).select("row", "key").withColumn("kind", F.lit(0)).unionByName(rare).select(
        "row", F.xxhash64("kind", "key").alias("key"))
    entries = common.write_table(meeting.join(names.select("row", "n"), "row"))

    likeliest = _aligned(rows, _meetings(entries, bags, component, best=True))
    linked = common.write_table(linked.unionByName(likeliest))
    rest = _aligned(rows, _meetings(entries, bags, components(linked), best=False))
    found = common.write_table(linked.unionByName(rest))
    common.drop_since(spark, start, 1)
    return found


def classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row with class_id and kept.

    ``class_id`` is the smallest doc_id of the rows whose texts are linked, directly or through
    others, by a word edit similarity of at least SIMILARITY; texts with the same words are one.
    ``kept`` marks one row of each class: the smallest doc_id, of repeated ids one. Null texts and
    texts without words are alike to nothing: each is its own class and kept. A null doc_id
    comes after all others. Input columns called class_id or kept are replaced.
    """
    names = [c for c in docs.columns if c not in ("class_id", "kept")]
    digest = F.when(F.col(text).rlike(common.WORD), F.sha2(F.regexp_replace(
        F.btrim(F.col(text), F.lit(" \t\n\x0b\x0c\r")), common.SPACE, " "), 256))
    rows = common.write_table(common.with_row_id(
        docs.select(F.struct(*names).alias("_in"), digest.alias("digest")), "row"))
    copies = common.write_table(rows.where("digest is not null").groupBy("digest").agg(F.min("row").alias("head")))
    texts = rows.where("digest is not null").select("row", F.col("_in")[text].alias("text"))
    linked = common.write_table(links(texts, copies.select(F.col("head").alias("row"))))
    groups = components(linked)
    # Rows to the head of their copies, heads to their component.
    member = rows.select("row", "digest", F.col("_in.doc_id").alias("doc_id")).join(copies, "digest", "left")
    member = member.withColumn("head", F.coalesce("head", "row")).join(
        groups.select(F.col("node").alias("head"), "component"), "head", "left")
    member = common.write_table(member.select("row", "doc_id", F.coalesce("component", "head").alias("group")))
    best = member.groupBy("group").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(
        F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))).alias("first"))
    said = common.write_table(member.join(best, "group").select(
        "row", "class_id", (F.col("row") == F.col("first.row")).alias("kept"), F.col("class_id").eqNullSafe(F.col("doc_id")).alias("own")))
    # Rows that are their own class need no join, so their texts stay where they are.
    words, may = _bitmap(said.where("not (own and kept)").select("row"))
    whole = rows.select("_in", "row")
    joined = whole.join(words, may, "left_semi").join(said, "row").select("_in.*", "class_id", "kept")
    alone = whole.join(words, may, "left_anti").select(
        "_in.*", F.col("_in.doc_id").alias("class_id"), F.lit(True).alias("kept"))
    return joined.unionByName(alone)
