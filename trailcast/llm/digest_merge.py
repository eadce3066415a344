"""Exact duplicates of texts: sorted digest runs that partitions merge in binomial rounds.

Every leaf (a bounded stretch of an input partition) turns its texts into one sorted run of digests
with their counts and best identifiers. In each round ``fan`` neighbouring nodes of the tree exchange
their runs; what meets is merged, and each digest keeps its best identifier. Runs are cut by digest
range, finer by a factor of ``fan`` each round, so a node never holds more than a leaf did. A digest
is one row for each node however many copies the node has, so no group of copies lies in one task.
The answers for repeated digests go back down the same tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trailcast.llm import common

#: Rows of a leaf, at most.
LEAF_ROWS = 1 << 17
#: Nodes that exchange their runs in a round.
FAN = 8
#: Entries of a task of a round, about.
TASK_ENTRIES = 500_000

_ENTRY = "node long, key long, sha binary, n_bytes long, id long, row long, n long"
_DIGEST = ["key", "sha", "n_bytes"]


def _digests(key_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.buffers(batch.column("text"))
            shas = []
            for a, b in common.pieces(offsets):
                low = memoryview(common.lowered(data[offsets[a]:offsets[b]]))
                ends = (offsets[a:b + 1] - offsets[a]).tolist()
                shas += [hashlib.sha256(low[x:y]).digest() for x, y in zip(ends[:-1], ends[1:])]
            head = np.frombuffer(b"".join(shas), ">u8").reshape(-1, 4)[:, 0].astype(np.uint64)
            key = (head >> np.uint64(1)).astype(np.int64) >> (63 - key_bits)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), pa.array(key), pa.array(shas, pa.binary()),
                 pa.array(np.diff(offsets))], ["row", "id", "key", "sha", "n_bytes"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted entries with equal digests folded: the first (best) identifier stays, counts add up.

    Two entries are one only if their whole digests and lengths agree, not just the sort keys. Memory
    is one batch: an open stretch is carried on as a single row.
    """
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = pa.RecordBatch.from_arrays(batch.columns, batch.schema.names)  # all columns nullable
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        numbers = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "key", "n_bytes")]
        # Digests have 32 bytes each, so their bytes lie in one buffer without gaps.
        sha = np.frombuffer(b"".join(batch.column("sha").to_pylist()), np.uint64).reshape(-1, 4)
        fresh = np.ones(batch.num_rows, bool)
        fresh[1:] = (sha[1:] != sha[:-1]).any(axis=1)
        for x in numbers:
            fresh[1:] |= x[1:] != x[:-1]
        starts = np.flatnonzero(fresh)
        counts = np.add.reduceat(batch.column("n").to_numpy(), starts)
        folded = batch.take(pa.array(starts))
        folded = folded.set_column(folded.schema.get_field_index("n"), "n", pa.array(counts))
        held = folded.slice(folded.num_rows - 1)
        yield folded.slice(0, folded.num_rows - 1)
    if held is not None:
        yield held


def _order(keep: str) -> list[Column]:
    first = F.col("id").desc_nulls_last() if keep == "largest" else F.col("id").asc_nulls_last()
    return [F.col("node"), *[F.col(c) for c in _DIGEST], first, F.col("row")]


def _exchanged(entries: DataFrame, step: int, fan: int, key_bits: int, keep: str, tasks: int) -> DataFrame:
    """One round: ``fan`` nodes become one, dealt by node and digest range, and their sorted runs merge."""
    bits = min(key_bits, step * (fan - 1).bit_length() + 4)
    up = entries.withColumn("node", F.expr(f"node div {fan}"))
    dealt = up.repartition(tasks, F.col("node"), F.shiftright("key", key_bits - bits))
    return dealt.sortWithinPartitions(*_order(keep)).mapInArrow(_merge, _ENTRY)


def groups(docs: DataFrame, keep: str = "largest", doc_id: str = "doc_id", text: str = "text", fan: int = FAN,
           key_bits: int = 63, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; texts are equal after A-Z are lower-cased.

    Of equal texts the row with the largest (``keep="smallest"``: smallest) identifier stays; rows without
    one stay only among themselves (keep_id is null then). Exactly one row of a group is kept, also when
    rows repeat an identifier. A null text counts as empty, and all empty texts are one group. Texts are
    read whole, once. An empty table gives an empty result; other columns are ignored. ``key_bits`` of the
    digest order the runs; equal keys are told apart by the whole digest and the length.
    """
    spark = docs.sparkSession
    hashed = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("id"),
                         F.col(text).cast("string").alias("text")).mapInArrow(
        _digests(key_bits), "row long, id long, key long, sha binary, n_bytes long")
    rows = common.write_table(hashed)  # fixes the row numbers, too
    inside = F.col("row").bitwiseAND((1 << 33) - 1)
    n, longest, parts = rows.agg(F.count(F.lit(1)), F.max(inside), F.max(F.shiftright("row", 33))).first()
    blocks = (longest or 0) // leaf_rows + 1
    rows = rows.withColumn("node", F.shiftright("row", 33) * blocks + F.floor(inside / leaf_rows))
    tasks = common.tasks(spark, n, TASK_ENTRIES)

    runs = rows.withColumn("n", F.lit(1).cast("long")).select(*[c.split()[0] for c in _ENTRY.split(", ")])
    runs = runs.sortWithinPartitions(*_order(keep)).mapInArrow(_merge, _ENTRY)
    levels, nodes = [], ((parts or 0) + 1) * blocks
    while nodes > 1 or not levels:
        runs = common.write_table(_exchanged(runs, len(levels) + 1, fan, key_bits, keep, tasks))
        levels.append(runs)
        nodes = -(-nodes // fan)

    # Down again: each node learns the group of those of its digests that repeat somewhere.
    told = levels.pop().where("n > 1").select("node", *_DIGEST, F.col("id").alias("keep_id"), F.col("row").alias("keep_row"),
                                              F.col("n").alias("size"))
    while levels:
        below = levels.pop().select("node", *_DIGEST).withColumn("up", F.expr(f"node div {fan}"))
        told = below.join(told.withColumnRenamed("node", "up"), ["up", *_DIGEST]).drop("up")
    own = rows.withColumn("up", F.expr(f"node div {fan}")).drop("node")
    out = own.join(told.withColumnRenamed("node", "up"), ["up", *_DIGEST], "left")
    alone = F.col("size").isNull()
    return out.select(
        F.col("id").alias("doc_id"), F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
