"""Shared helpers: written tables in the cluster's shared folder, and vectorized words of Arrow text columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from trailcast.session import shared_folder

#: Bytes of text that are turned into numpy arrays at once.
CHUNK_BYTES = 1 << 19

#: The white space of the word pattern [^\x20\x09-\x0D]+ as a Spark (Java) pattern.
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"

_written: list[str] = []


def write_table(df: DataFrame, batch: int | None = None) -> DataFrame:
    """Write a table to the shared folder (``spark.checkpoint.dir``) and read it back.

    Cuts the lineage like ``checkpoint()``: the files outlive lost executors. They go with
    ``drop_tables``; the shuffle files of the job that writes go when it ends. ``batch`` is the
    number of rows that Arrow functions of the job get at once, for wide rows.
    """
    spark = df.sparkSession
    path = new_path(spark)
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if batch is not None:
        wanted["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(batch)
    before = {setting: spark.conf.get(setting) for setting in wanted}
    for setting, value in wanted.items():
        spark.conf.set(setting, value)
    try:
        # Small row groups: wide binary rows are read a row group at a time.
        df.write.option("compression", "zstd").option("parquet.block.size", 1 << 24).parquet(path)
    finally:
        for setting, value in before.items():
            spark.conf.set(setting, value)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession) -> str:
    """A path for a table in the shared folder."""
    return f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"


def drop_tables(spark: SparkSession) -> None:
    """Delete what earlier jobs wrote to the shared folder. Results not yet written elsewhere depend on it."""
    while _written:
        drop_path(spark, _written.pop())


def mark() -> int:
    """The tables written so far; see ``drop_since``."""
    return len(_written)


def drop_since(spark: SparkSession, start: int, but: int = 0) -> None:
    """Delete the tables written after a mark, except the last ``but`` ones, as soon as their last reader is done."""
    end = len(_written) - but
    for path in _written[start:end]:
        drop_path(spark, path)
    del _written[start:end]


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def with_row_id(df: DataFrame, name: str = "_row") -> DataFrame:
    """A unique number for each row. Stable only once the result is written."""
    return df.withColumn(name, F.monotonically_increasing_id())


def tasks(spark: SparkSession, weight: float, per_task: float) -> int:
    """Partitions so that each gets about ``per_task`` of ``weight``; at least the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(np.ceil(weight / per_task)))


# ---- words of a text column, without Python strings ----


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the offsets (from 0) of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes; a longer text is a range of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end
        start = end


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z in UTF-8 bytes."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the number of the first word after it (from 0)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = np.ones(n + 1, bool)
    first[1:n] = ~inside[:-1]
    first[offsets[offsets < n]] = True
    starts = np.flatnonzero(inside & first[:n])
    last = np.ones(n, bool)
    last[:-1] = ~inside[1:] | first[1:n]
    # A text's first byte ends the word before it even without white space.
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base = base
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            self.up = _powers(self.base, size)
            self.down = _powers(pow(self.base, -1, 1 << 64), size)
        return self.up, self.down


def _powers(base: int, size: int) -> np.ndarray:
    steps = np.full(size, np.uint64(base))
    steps[0] = 1
    return np.multiply.accumulate(steps)


#: Odd bases of the polynomial hashes: bytes to words, words to windows.
_BYTES = (Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93))
_WORDS = (Powers(0xA0761D6478BD642F), Powers(0xE7037ED1A0B428DB))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values (multiply and shift)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of each word; ``which`` chooses one of two independent functions."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _BYTES[which].get(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def window_hashes(words: np.ndarray, bounds: np.ndarray, size: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``size`` words inside a text, and the number of its first word."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _WORDS[which].get(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], out=sums[1:])
    lengths = np.diff(bounds)
    text_end = np.repeat(bounds[1:], lengths)
    at = np.arange(n - size + 1)
    at = at[at + size <= text_end[:n - size + 1]]
    return mix((sums[at + size] - sums[at]) * down[at]), at
