"""Running values along a run, for runs of any length.

Normally a run is one window partition. A run that is longer than a limit would
put too many rows into one task, so it is cut into blocks of consecutive
positions: every block is a window partition of its own, the block totals are
scanned once per run, and the value carried into each block is joined back. Both
forms give the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from trailcast.session import cut_lineage

HOT_RUN_ROWS = 1_000_000
BLOCK_ROWS = 65_536


@dataclass(frozen=True)
class Op:
    """One value along the run. ``rows`` is the look-back of the ``recent_*`` kinds."""

    kind: str
    value: Column
    rows: int = 1


def running_sum(value: Column) -> Op:
    return Op("sum", value)


def running_max(value: Column) -> Op:
    return Op("max", value)


def running_min(value: Column) -> Op:
    return Op("min", value)


def last_seen(value: Column) -> Op:
    """Last non-NULL value up to and including this row."""
    return Op("last", value)


def last_before(value: Column) -> Op:
    """Last non-NULL value strictly before this row."""
    return Op("before", value)


def previous(value: Column, rows: int = 1) -> Op:
    return Op("lag", value, rows)


def following(value: Column) -> Op:
    return Op("lead", value, 1)


def recent_sum(value: Column, rows: int) -> Op:
    return Op("recent_sum", value, rows)


def recent_avg(value: Column, rows: int) -> Op:
    return Op("recent_avg", value, rows)


def recent_list(value: Column, rows: int) -> Op:
    return Op("recent_list", value, rows)


_RECENT = {"recent_sum": F.sum, "recent_avg": F.avg, "recent_list": F.collect_list}
_TOTAL = {"sum": F.sum, "max": F.max, "min": F.min}


class RunScan:
    """Adds running columns to rows ordered by ``position`` inside each ``run``.

    ``block_rows`` cuts the runs; ``None`` keeps each run whole. Positions must be
    consecutive numbers from 0 when blocks are used.
    """

    def __init__(self, run: str = "trajectory_id", position: str = "step_index",
                 block_rows: int | None = None):
        self.run, self.position, self.block_rows = run, position, block_rows

    def _block(self) -> Column:
        return F.floor(F.col(self.position) / F.lit(self.block_rows)).cast("bigint")

    def apply(self, df: DataFrame, **ops: Op) -> DataFrame:
        if self.block_rows is None:
            w = Window.partitionBy(self.run).orderBy(self.position)
            return df.withColumns({name: self._over(op, op.value, w) for name, op in ops.items()})
        return self._apply_blocks(df, ops)

    @staticmethod
    def _over(op: Op, value: Column, w) -> Column:
        if op.kind in _TOTAL:
            return _TOTAL[op.kind](value).over(w.rowsBetween(Window.unboundedPreceding, 0))
        if op.kind == "last":
            return F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        if op.kind == "before":
            return F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        if op.kind == "lag":
            return F.lag(value, op.rows).over(w)
        if op.kind == "lead":
            return F.lead(value, op.rows).over(w)
        return _RECENT[op.kind](value).over(w.rowsBetween(-(op.rows - 1), 0))

    def _apply_blocks(self, df: DataFrame, ops: dict[str, Op]) -> DataFrame:
        run, pos = self.run, self.position
        base = cut_lineage(df)
        before = max([op.rows for op in ops.values() if op.kind in _RECENT or op.kind == "lag"] or [0])
        after = max([op.rows for op in ops.values() if op.kind == "lead"] or [0])
        if max(before, after) > self.block_rows:
            raise ValueError("look-back is longer than a block")
        own = self._block()
        place = F.col(pos) - own * self.block_rows
        blocks = F.filter(
            F.array(own, F.when(place >= self.block_rows - before, own + 1),
                    F.when((place < after) & (own > 0), own - 1)),
            lambda b: b.isNotNull(),
        )
        spread = base.withColumn("_block", F.explode(blocks)).withColumn(
            "_guest", F.col("_block") != own)
        w = Window.partitionBy(run, "_block").orderBy(pos)
        carried = {n: op for n, op in ops.items() if op.kind in _TOTAL or op.kind in ("last", "before")}
        local = spread.withColumns({
            name: self._over(op, F.when(~F.col("_guest"), op.value) if name in carried else op.value, w)
            for name, op in ops.items()
        }).where(~F.col("_guest"))
        if carried:
            totals = base.groupBy(run, own.alias("_block")).agg(*[
                (F.max_by(op.value, F.when(op.value.isNotNull(), F.col(pos)))
                 if op.kind in ("last", "before") else _TOTAL[op.kind](op.value)).alias("_t_" + name)
                for name, op in carried.items()
            ])
            earlier = Window.partitionBy(run).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
            carry = totals.select(run, "_block", *[
                (F.last("_t_" + name, ignorenulls=True) if op.kind in ("last", "before")
                 else _TOTAL[op.kind]("_t_" + name)).over(earlier).alias("_c_" + name)
                for name, op in carried.items()
            ])
            local = local.join(carry, [run, "_block"], "left").withColumns({
                name: self._combine(op, F.col(name), F.col("_c_" + name)) for name, op in carried.items()
            })
        return local.select(*df.columns, *[n for n in ops if n not in df.columns])

    @staticmethod
    def _combine(op: Op, local: Column, carry: Column) -> Column:
        if op.kind == "sum":
            return F.coalesce(local + carry, local, carry)
        if op.kind == "max":
            return F.greatest(local, carry)
        if op.kind == "min":
            return F.least(local, carry)
        return F.coalesce(local, carry)

    def occurrences(self, df: DataFrame, **counted: tuple[Column, list[Column]]) -> DataFrame:
        """Running count, per run and key, of the rows that meet a condition.

        ``name=(condition, [key columns])``. Rows of one position are ordered by the
        key itself, so counts do not depend on row order.
        """
        named = df
        key_names: dict[str, list[str]] = {}
        for name, (_, keys) in counted.items():
            key_names[name] = [f"_k_{name}_{i}" for i in range(len(keys))]
            named = named.withColumns({
                kn: F.coalesce(k.cast("string"), F.lit("")) for kn, k in zip(key_names[name], keys)})
        named = named.withColumns({f"_f_{n}": F.coalesce(c, F.lit(False)).cast("bigint")
                                   for n, (c, _) in counted.items()})
        if self.block_rows is not None:
            named = cut_lineage(named.withColumn("_block", self._block()))
        out = named
        for name in counted:
            part = [self.run] + (["_block"] if self.block_rows is not None else []) + key_names[name]
            w = Window.partitionBy(*part).orderBy(self.position, *self._tie(df)).rowsBetween(
                Window.unboundedPreceding, 0)
            out = out.withColumn(name, F.sum(f"_f_{name}").over(w))
        if self.block_rows is not None:
            for name in counted:
                keys = [self.run] + key_names[name]
                totals = named.groupBy(*keys, "_block").agg(F.sum(f"_f_{name}").alias("_t"))
                earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
                    Window.unboundedPreceding, -1)
                carry = totals.select(*keys, "_block",
                                      F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_c"))
                out = out.join(carry, [*keys, "_block"], "left").withColumn(
                    name, F.col(name) + F.col("_c")).drop("_c")
        return out.select(*df.columns, *counted)

    @staticmethod
    def _tie(df: DataFrame) -> list[str]:
        return ["file"] if "file" in df.columns else []


def long_runs(df: DataFrame, run: str = "trajectory_id", limit: int = HOT_RUN_ROWS) -> DataFrame:
    """Runs with more than ``limit`` rows. There are at most total / limit of them."""
    return df.groupBy(run).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(run)


def by_run_length(df: DataFrame, job, run: str = "trajectory_id", position: str = "step_index",
                  limit: int = HOT_RUN_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Run ``job(rows, scan)`` with whole runs, and once more in blocks for over-long runs.

    Looking for long runs is one pre-aggregated pass over the run column.
    """
    whole = RunScan(run, position)
    hot = long_runs(df, run, limit)
    if hot.isEmpty():
        return job(df, whole)
    short = job(df.join(hot, run, "left_anti"), whole)
    long = job(df.join(hot, run, "left_semi"), RunScan(run, position, block_rows))
    return short.unionByName(long)
