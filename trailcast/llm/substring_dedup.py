"""Substring dedup: remove words of windows that start more than once, with a count-min prefilter.

1. Rows are packed, compressed, into blocks of bounded size and written.
2. Each task sketches its windows (count-min rows cut into slices, as sorted counter positions);
   slices are summed by Spark, and only "count of two or more" stays, one bit a counter.
3. Windows that the merged sketch estimates repeated go, once for each block, by hash to slices
   that count them exactly on a 96-bit fingerprint; the repeated ones return to their blocks.
4. Blocks meet their repeated windows again and remove the covered words.

A sketch never counts too few, so no repeated window is lost whatever the sketch's size; when its
bounded size is outgrown, more windows take the exact step. A window in many documents is one row
for each block, so it does not pile up in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from trailcast.llm import common

#: Words of a window.
WINDOW = 35
#: Rows of the sketch.
DEPTH = 2
#: Counters of a sketch row: a power of two, about four for each window but never more than this.
#: The merged sketch is one bit a counter: at most DEPTH * 2**28 / 8 = 64 MB are broadcast.
MOST_COUNTERS = 1 << 28
#: Counters of a slice of a sketch row, merged by one task.
SLICE = 1 << 22
#: Windows sketched before a task hands them on: bounds its memory.
FLUSH = 1 << 21
#: Bytes of text, about, and rows of a block at most. A longer text is a block of its own.
BLOCK_BYTES, BLOCK_ROWS = 1 << 21, 4096
#: Candidate windows of a block that one exact step counts, about.
PER_GROUP = 1 << 20


def _windows(texts: pa.Array, both: bool) -> Iterator[tuple]:
    """For pieces of texts: range of texts, word starts, ends, bounds, first words of windows, their hashes."""
    data, offsets = common.buffers(texts)
    for start, end in common.pieces(offsets):
        part = data[offsets[start]:offsets[end]]
        starts, ends, bounds = common.word_bounds(part, offsets[start:end + 1] - offsets[start])
        hashes, at = common.window_hashes(common.word_hashes(part, starts, ends, 0), bounds, WINDOW, 0)
        second = (common.window_hashes(common.word_hashes(part, starts, ends, 1), bounds, WINDOW, 1)[0]
                  >> np.uint64(32)).astype(np.uint32) if both else None
        yield start, end, part, starts, ends, bounds, at, hashes, second


def _counters(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Counter of each window in a row of the sketch: other bits of the hash for each row."""
    if row:
        hashes = common.mix(hashes + np.uint64(row))
    return hashes >> np.uint64(64 - bits)


def _pack_blocks(at: int):
    """Rows to blocks: one compressed payload each, with the bytes of text in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        size = rows = made = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, rows, made
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            block = pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + made], pa.int64()), pa.array([size], pa.int64()),
                 pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "size", "payload"])
            held, size, rows, made = [], 0, 0, made + 1
            return block

        for batch in batches:
            _, offsets = common.buffers(batch.column(at))
            start = 0
            while start < batch.num_rows:
                end = int(np.searchsorted(offsets, offsets[start] + BLOCK_BYTES - size, side="right")) - 1
                end = min(batch.num_rows, max(end, start + (not held)), start + BLOCK_ROWS - rows)
                if end > start:
                    held.append(batch.slice(start, end - start))
                    size += int(offsets[end] - offsets[start])
                    rows += end - start
                    start = end
                if size >= BLOCK_BYTES or rows >= BLOCK_ROWS or start < batch.num_rows:
                    yield flush()
        if held:
            yield flush()

    return run


def _unpack_block(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all().combine_chunks()


def _sketch(at: int, bits: int):
    """Sorted counter positions by (row, slice), each at most twice in a hand-over."""
    slice_bits = min(bits, SLICE.bit_length() - 1)

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes = np.concatenate(held)
        for row in range(DEPTH):
            at = np.sort(_counters(hashes, row, bits))
            if len(at) > 2:
                at = at[np.append([True, True], at[2:] != at[:-2])]
            piece = at >> np.uint64(slice_bits)
            edges = np.append(np.flatnonzero(np.append(True, piece[1:] != piece[:-1])), len(at))
            names, payload = [], []
            for a, b in zip(edges[:-1], edges[1:]):
                names.append(int(piece[a]))
                payload.append(_pack((at[a:b] & np.uint64((1 << slice_bits) - 1)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([row] * len(names), pa.int32()), pa.array(names, pa.int64()), pa.array(payload, pa.binary())],
                ["row", "slice", "positions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for payload in _payloads(batches):
            for piece in _windows(_unpack_block(payload).column(at), False):
                held.append(piece[7])
                size += len(piece[7])
                if size >= FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return run


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in batches:
        for payload in batch.column("payload"):
            yield payload.as_buffer()


def _pack(sorted_values: np.ndarray) -> bytes:
    """Sorted numbers as 16-bit differences; a larger difference takes steps of 65535."""
    steps = np.diff(sorted_values, prepend=0)
    if len(steps) and steps.max() < 65535:
        return steps.astype(np.uint16).tobytes()
    wide = steps // 65535
    out = np.full(len(steps) + int(wide.sum()), 65535, np.uint16)
    out[np.arange(len(steps)) + np.cumsum(wide)] = (steps % 65535).astype(np.uint16)
    return out.tobytes()


def _unpack(payload: bytes) -> np.ndarray:
    steps = np.frombuffer(payload, np.uint16)
    return np.cumsum(steps, dtype=np.int64)[steps != 65535]


def _merge(bits: int):
    """Sum the counters of a slice over all partitions; one bit says whether two or more were counted."""
    size = min(1 << bits, SLICE)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, more = np.zeros(size, bool), np.zeros(size, bool)
        for batch in batches:
            for payload in batch.column("positions").to_pylist():
                at = _unpack(payload)
                again = at[1:][at[1:] == at[:-1]]
                more[again] = True
                more[at[once[at]]] = True
                once[at] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()),
             pa.array([np.packbits(more).tobytes()], pa.binary())], ["row", "slice", "bits"])

    return run


def sketch(blocks: DataFrame, at: int, bits: int) -> np.ndarray:
    """The merged sketch of all windows of column ``at``: for each row one bit a counter (two or more)."""
    parts = blocks.select("payload").mapInArrow(_sketch(at, bits), "row int, slice long, positions binary")
    merged = common.write_table(parts.groupBy("row", "slice").applyInArrow(_merge(bits), "row int, slice long, bits binary"))
    out = np.zeros((DEPTH, max(1, (1 << bits) >> 3)), np.uint8)
    size = min(1 << bits, SLICE) >> 3
    for r in merged.toLocalIterator():  # at most MOST_COUNTERS bits a row, in all
        out[r["row"], r["slice"] * size:(r["slice"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def _estimated(hashes: np.ndarray, merged: np.ndarray, bits: int) -> np.ndarray:
    """Which windows the sketch estimates to occur at least twice."""
    said = np.arange(len(hashes))
    for row in range(DEPTH):
        at = _counters(hashes[said], row, bits).astype(np.int64)
        said = said[(merged[row][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0]
    return said


_ENTRY = np.dtype([("high", np.uint64), ("low", np.uint32), ("n", np.uint8)])


def _candidates(at: int, shared, bits: int, groups: int):
    """Estimated windows of each block, each once with the number of its starts (2: more), by group."""

    def entries_of(texts: pa.Array) -> np.ndarray:
        merged, held = shared.value, []
        for piece in _windows(texts, True):
            said = _estimated(piece[7], merged, bits)
            held.append((piece[7][said], piece[8][said]))
        high = np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in held)])
        low = np.concatenate([np.zeros(0, np.uint32), *(x for _, x in held)])
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        first = np.flatnonzero(np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))) if len(high) else []
        entries = np.empty(len(first), _ENTRY)
        entries["high"], entries["low"] = high[first], low[first]
        entries["n"] = np.minimum(np.diff(np.append(first, len(high))), 2)
        return entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                entries = entries_of(_unpack_block(payload.as_buffer()).column(at))
                if not len(entries):
                    continue
                group = (entries["low"] % np.uint32(groups)).astype(np.int64)
                order = np.argsort(group, kind="stable")
                entries, group = entries[order], group[order]
                edges = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * (len(edges) - 1), pa.int64()), pa.array(group[edges[:-1]], pa.int64()),
                     pa.array([entries[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())],
                    ["block", "part", "windows"])

    return run


def _exact(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of one group that start at least twice, for each block that has them."""
    blocks, parts = [], []
    for batch in batches:
        blocks.extend(batch.column("block").to_pylist())
        parts.extend(np.frombuffer(x, _ENTRY) for x in batch.column("windows").to_pylist())
    sizes = np.array([len(p) for p in parts])
    entries = np.concatenate(parts)
    owner = np.repeat(np.arange(len(parts)), sizes)
    order = np.lexsort((entries["low"], entries["high"]))
    high, low = entries["high"][order], entries["low"][order]
    first = np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))
    number = np.cumsum(first) - 1
    counts = np.bincount(number, weights=entries["n"][order])
    said = np.zeros(len(entries), bool)
    said[order] = counts[number] >= 2
    entries, owner = entries[said], owner[said]
    edges = np.searchsorted(owner, np.arange(len(parts) + 1))
    found = [(blocks[k], np.sort(entries["high"][edges[k]:edges[k + 1]]).tobytes())
             for k in range(len(parts)) if edges[k] < edges[k + 1]]
    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int64()),
                                      pa.array([x for _, x in found], pa.binary())], ["block", "windows"])


def _removed(repeated: np.ndarray, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text its bytes, word starts and ends, and which words are removed."""
    for start, end, part, starts, ends, bounds, at, hashes, _ in _windows(texts, False):
        cover = np.zeros(len(starts) + 1, np.int64)
        if len(repeated) and len(hashes):
            hit = at[repeated[np.minimum(np.searchsorted(repeated, hashes), len(repeated) - 1)] == hashes]
            cover[hit] += 1
            np.subtract.at(cover, hit + WINDOW, 1)
        gone = np.cumsum(cover[:-1]) > 0
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield part, starts[a:b], ends[a:b], gone[a:b]


def _kept_text(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> bytes:
    """Kept words joined by one space."""
    kept = ~gone
    starts, ends = starts[kept], ends[kept]
    if not len(starts):
        return b""
    raw = part[starts[0]:ends[-1]].tobytes()
    if not gone[kept.argmax():len(kept) - kept[::-1].argmax()].any():
        return b" ".join(raw.split())
    base = starts[0]
    return b" ".join([raw[a:b] for a, b in zip((starts - base).tolist(), (ends - base).tolist())])


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row with kept_text, n_words and n_removed.

    A word goes if a window of WINDOW words covers it whose words also start anywhere else, in the
    same text or another; windows are judged on the input. ``kept_text`` has the kept words joined
    by one space; a text that loses no word keeps its own form. Null texts stay null and, like empty
    texts and texts shorter than a window, lose nothing. Repeated rows repeat each other's windows:
    all of them lose those. Input columns called like the new ones are replaced.
    """
    spark = docs.sparkSession
    rows = docs.drop("kept_text", "n_words", "n_removed")
    at, width = rows.columns.index(text), len(rows.columns)
    blocks = common.write_table(rows.mapInArrow(_pack_blocks(at), "block long, size long, payload binary"))
    size, n_blocks = blocks.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    windows = size / 6.5  # about: a word and its space
    bits = max(3, min(int(3 * windows).bit_length(), MOST_COUNTERS.bit_length() - 1))
    merged = sketch(blocks, at, bits)
    shared = spark.sparkContext.broadcast(merged)
    fill = [float(np.bitwise_count(merged[r]).sum()) / (1 << bits) for r in range(DEPTH)]
    groups = common.tasks(spark, windows * (0.3 + float(np.prod(fill))), PER_GROUP)
    found = blocks.select("block", "payload").mapInArrow(
        _candidates(at, shared, bits, groups), "block long, part long, windows binary")
    repeated = common.write_table(found.groupBy("part").applyInArrow(_exact, "block long, windows binary"))
    shared.unpersist()

    def clean(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, np.uint64) for x in right.column("windows").to_pylist()]
        keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        out = []
        for payload in left.column("payload").to_pylist():  # one, as block numbers are unique
            own = _unpack_block(payload)
            texts = own.column(at).combine_chunks()
            kept, counts, gone_counts = [], [], []
            for k, (part, starts, ends, gone) in enumerate(_removed(keys, texts)):
                lost = int(gone.sum())
                kept.append(_kept_text(part, starts, ends, gone).decode() if lost else texts[k].as_py())
                counts.append(len(starts))
                gone_counts.append(lost)
            out.append(pa.table([*own.columns, pa.array(kept, pa.string()), pa.array(counts, pa.int64()),
                                 pa.array(gone_counts, pa.int64())],
                                names=[*(f"c{k}" for k in range(width)), "kept_text", "n_words", "n_removed"]))
        return pa.concat_tables(out) if out else empty.empty_table()

    schema = StructType([StructField(f"c{k}", f.dataType) for k, f in enumerate(rows.schema.fields)]
                        + [StructField("kept_text", StringType()), StructField("n_words", LongType()),
                           StructField("n_removed", LongType())])
    empty = to_arrow_schema(schema)
    # As many tasks as blocks make about 32 MB of text each.
    cut = common.tasks(spark, n_blocks, 16)
    cleaned = blocks.select("block", "payload").repartition(cut, "block").groupBy("block").cogroup(
        repeated.repartition(cut, "block").groupBy("block")).applyInArrow(clean, schema)
    return cleaned.toDF(*rows.columns, "kept_text", "n_words", "n_removed")
