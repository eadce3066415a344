"""Histogram boosting with second-order leaves, for many models at once.

Features are binned once. Models are trained side by side: a row carries the names of the models it
trains, and every pass over the data serves all of them. A model with up to ``TASK_ROWS`` rows is grown
by one task of its own, so hundreds of small fits (folds, subsets, feature families) are one job. The rows of
larger models stay on the executors as column blocks with their margins; each step is one job without a shuffle
that sums by (model, node, feature, bin) for all models that still grow, and only these sums reach the driver.
Gradients are whole multiples of 1 / ``QUANTUM``, so sums do not depend on their order and both ways give the
same trees.

Trees grow best leaf first; a leaf is worth -G / (H + l2).
"""

from __future__ import annotations

import heapq
import json
import pickle
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from trailcast.session import reuse, shared_folder

#: Rows of a model, and rows times columns, at most, that one task grows.
TASK_ROWS, TASK_CELLS = 500_000, 20_000_000
#: Gradients, hessians and weights are rounded to 1 / QUANTUM.
QUANTUM = float(1 << 24)
#: Trees after which large models write their margins anew.
SEGMENT = 10
#: Rows of a block of a large model, at most.
BLOCK_ROWS = 65_536
#: Distinct values of a feature up to which every value gets its own bin.
MAX_BINS = 255
#: Rows that are scored at once.
SCORED = 2048


@dataclass(frozen=True)
class Settings:
    # Usual settings of histogram boosting; rounds, rate and l2 are those of the roster.
    rounds: int = 300
    rate: float = 0.08
    l2: float = 1.0
    leaves: int = 31
    min_rows: int = 20
    min_hessian: float = 1e-3
    early_rows: int = 10_000  # beyond these a tenth of the rows is held out to stop early
    patience: int = 10
    tolerance: float = 1e-7


@dataclass
class Trees:
    """One model: nodes of all trees in flat arrays; a leaf points to itself."""

    baseline: float
    roots: list[int] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, tree: dict, edges: list[np.ndarray]) -> None:
        start = len(self.feature)
        self.roots.append(start)
        for i, (f, b, l, r) in enumerate(zip(tree["feature"], tree["bin"], tree["left"], tree["right"])):
            leaf = l == i
            self.feature.append(0 if leaf else f)
            self.threshold.append(0.0 if leaf else float(edges[f][b]))
            self.left.append(start + l)
            self.right.append(start + r)
        self.value += tree["value"]

    def margins(self, x: np.ndarray) -> np.ndarray:
        feature, threshold = np.array(self.feature, np.int64), np.array(self.threshold)
        left, right, value = np.array(self.left, np.int64), np.array(self.right, np.int64), np.array(self.value)
        out = np.full(len(x), self.baseline)
        if not self.roots:
            return out
        for start in range(0, len(x), SCORED):
            part = x[start:start + SCORED]
            rows = np.arange(len(part))[:, None]
            at = np.tile(np.array(self.roots, np.int64), (len(part), 1))
            while True:
                then = np.where(part[rows, feature[at]] <= threshold[at], left[at], right[at])
                if (then == at).all():
                    break
                at = then
            # Tree by tree, as in training.
            out[start:start + SCORED] = np.cumsum(np.concatenate(
                [out[start:start + SCORED, None], value[at]], axis=1), axis=1)[:, -1]
        return out


# ---- bins ----


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, v): the values of column ``i`` in a task, or MAX_BINS + 1 of them if there are more."""
    known: list[np.ndarray] = []
    for batch in batches:
        known = known or [np.zeros(0)] * batch.num_columns
        for i, have in enumerate(known):
            if len(have) <= MAX_BINS:
                known[i] = np.unique(np.concatenate([have, batch.column(i).to_numpy(zero_copy_only=False)]))[:MAX_BINS + 1]
    for i, have in enumerate(known):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(have), i, np.int32)), pa.array(have)], ["i", "v"])


def bin_edges(df: DataFrame, columns: list[str]) -> list[np.ndarray]:
    """Upper edges of the bins of each column: midpoints of its values, or of its quantiles if they are many."""
    if not columns:
        return []
    pairs = df.select(*columns).mapInArrow(_values, "i int, v double").distinct().groupBy("i").agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("v")).alias("v")).select(
        "i", F.when(F.col("n") <= MAX_BINS, F.col("v")).alias("v"))
    found = {r["i"]: r["v"] for r in pairs.collect()}  # at most MAX_BINS values of each column
    values: dict[int, np.ndarray] = {i: np.array(v, float) for i, v in found.items() if v is not None}
    many = [i for i in range(len(columns)) if i in found and i not in values]
    if many:
        shares = [k / MAX_BINS for k in range(MAX_BINS + 1)]
        found = df.agg(*[F.percentile_approx(columns[i], shares, 20_000).alias(str(i)) for i in many]).first()
        for i, cuts in zip(many, found):
            values[i] = np.unique(np.array(cuts or [], float))
    return [(values[i][:-1] + values[i][1:]) / 2 if len(values.get(i, ())) > 1 else np.zeros(0) for i in range(len(columns))]


def _binned(columns: list[str], edges: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = np.empty((batch.num_rows, len(columns)), np.uint8)
            for i, e in enumerate(edges):
                bins[:, i] = np.searchsorted(e, batch.column(i).to_numpy(zero_copy_only=False), side="left")
            rest = batch.schema.names[len(columns):]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.tobytes() for b in bins], pa.binary()), *[batch.column(c) for c in rest]], ["bins", *rest])

    return run


# ---- growing a tree ----


@dataclass
class _Node:
    totals: tuple[float, float, float]  # sums of gradients and hessians (in quanta), rows
    measured: bool = False
    split: tuple | None = None  # gain, feature, bin, totals of the left side
    children: tuple[int, int] | None = None


class Growing:
    """A tree that grows best leaf first. Nodes can be measured ahead of their turn; the tree stays the same."""

    def __init__(self, s: Settings):
        self.s, self.nodes, self.taken = s, [_Node((0.0, 0.0, 0.0))], []

    def wanted(self, ahead: bool) -> list[int]:
        """Nodes whose best split must be known to go on; none when the tree is complete."""
        if not self.nodes[0].measured:
            return [0]
        wanted, self.taken, order = [], [], 0
        heap = [(-self.nodes[0].split[0], 0, 0)] if self.nodes[0].split else []
        while heap and len(self.taken) + 1 < self.s.leaves:
            _, _, i = heapq.heappop(heap)
            node = self.nodes[i]
            if node.children is None:
                node.children = (len(self.nodes), len(self.nodes) + 1)
                part = node.split[3]
                for totals in (part, tuple(t - p for t, p in zip(node.totals, part))):
                    self.nodes.append(_Node(totals, measured=totals[2] < 2 * self.s.min_rows))
            self.taken.append(i)
            for child in node.children:
                c, order = self.nodes[child], order + 1
                if not c.measured:
                    if len(self.taken) + 1 < self.s.leaves:  # after the last split nothing more is needed
                        wanted.append(child)
                elif c.split:
                    heapq.heappush(heap, (-c.split[0], order, child))
            if wanted and not ahead:
                break
        return wanted

    def measure(self, i: int, totals: tuple | None, split: tuple | None) -> None:
        node = self.nodes[i]
        node.measured, node.split = True, split
        if totals is not None:
            node.totals = totals

    def routing(self) -> dict:
        """Arrays that lead a row to its deepest known node."""
        n = len(self.nodes)
        out = {"feature": np.zeros(n, np.int64), "bin": np.zeros(n, np.int64), "left": np.arange(n), "right": np.arange(n)}
        for i, node in enumerate(self.nodes):
            if node.children is not None:
                out["feature"][i], out["bin"][i] = node.split[1], node.split[2]
                out["left"][i], out["right"][i] = node.children
        return out

    def tree(self) -> dict:
        """The finished tree: its nodes and the values of its leaves."""
        number, order = {}, [0]
        split = set(self.taken)
        for i in order:
            number[i] = len(number)
            if i in split:
                order += self.nodes[i].children
        out = {"feature": [], "bin": [], "left": [], "right": [], "value": []}
        for i in order:
            node, own = self.nodes[i], number[i]
            inner = i in split
            g, h = node.totals[0] / QUANTUM, node.totals[1] / QUANTUM
            out["feature"].append(int(node.split[1]) if inner else 0)
            out["bin"].append(int(node.split[2]) if inner else 0)
            out["left"].append(number[node.children[0]] if inner else own)
            out["right"].append(number[node.children[1]] if inner else own)
            out["value"].append(0.0 if inner else -self.s.rate * g / (h + self.s.l2 + 2.0**-52))
        return out


def route(tree: dict, bins: np.ndarray) -> np.ndarray:
    feature, cut = np.asarray(tree["feature"]), np.asarray(tree["bin"])
    left, right = np.asarray(tree["left"]), np.asarray(tree["right"])
    inner = left != np.arange(len(left))
    out = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins)) if inner[0] else np.zeros(0, np.int64)
    at = np.zeros(len(rows), np.int64)
    while len(rows):
        at = np.where(bins[rows, feature[at]] <= cut[at], left[at], right[at])
        out[rows] = at
        moving = inner[at]
        rows, at = rows[moving], at[moving]
    return out


def _slopes(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1.0 / (1.0 + np.exp(-margin))
    return np.rint((p - y) * w * QUANTUM), np.rint(np.maximum(p * (1 - p), 1e-16) * w * QUANTUM)


def _loss(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    return float(np.rint((np.logaddexp(0.0, margin) - y * margin) * w * QUANTUM).sum())


def _stops(losses: list[float], s: Settings) -> bool:
    if len(losses) <= s.patience:
        return False
    return not any(-x > -losses[-s.patience - 1] + s.tolerance for x in losses[-s.patience:])


def _baseline(pos: float, total: float) -> float:
    return float(np.log(pos / (total - pos))) if 0 < pos < total else (-20.0 if pos <= 0 else 20.0)


class _Histograms:
    """Best splits from sums over (node, feature, bin) in one flat array a node."""

    def __init__(self, widths: list[int], allowed: list[int], s: Settings):
        self.s, self.allowed = s, np.array(allowed, np.int64)
        own = np.array([widths[f] for f in allowed], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(own)]).astype(np.int64)
        self.total = int(self.starts[-1])
        self.feature = np.repeat(self.allowed, own)
        self.bin = np.arange(self.total) - np.repeat(self.starts[:-1], own)
        self.first = np.repeat(self.starts[:-1], own)
        self.inner = self.bin < np.repeat(own, own) - 1

    def sums(self, bins: np.ndarray, slot: np.ndarray | None, n: int, g: np.ndarray, h: np.ndarray,
             rows: np.ndarray | None = None) -> np.ndarray:
        """Sums of gradients, hessians and rows by (slot, bin), feature by feature, of ``rows`` of ``bins`` (or all)."""
        out = np.empty((3, n, self.total))
        for f, start, end in zip(self.allowed, self.starts[:-1], self.starts[1:]):
            column, width = bins[:, f], int(end - start)
            key = (column if rows is None else column[rows]).astype(np.intp)
            if slot is not None:
                key += slot * width
            for k, x in enumerate((g, h, None)):
                out[k, :, start:end] = np.bincount(key, x, n * width).reshape(n, width)
        return out

    def best(self, sums: np.ndarray) -> list[tuple[tuple, tuple | None]]:
        """For each node of ``sums`` (3, nodes, bins) its totals and its best split (the first of equal ones)."""
        n = sums.shape[1]
        if not self.total:
            return [((0.0, 0.0, 0.0), None)] * n
        cum = np.cumsum(sums, axis=2)
        left = cum - (cum[:, :, self.first] - sums[:, :, self.first])
        all_ = sums[:, :, :self.starts[1]].sum(axis=2)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = gains(left[0] / QUANTUM, left[1] / QUANTUM, all_[0][:, None] / QUANTUM, all_[1][:, None] / QUANTUM, self.s.l2)
        low = self.s.min_hessian * QUANTUM
        rest = all_[1:, :, None] - left[1:]
        ok = self.inner & (left[2] >= self.s.min_rows) & (rest[1] >= self.s.min_rows) & (left[1] >= low) & (rest[0] >= low)
        gain = np.where(ok, gain, -np.inf)
        out = []
        for k, at in enumerate(gain.argmax(axis=1).tolist()):
            split = (float(gain[k, at]), int(self.feature[at]), int(self.bin[at]), tuple(left[:, k, at].tolist())) if gain[k, at] > 0 else None
            out.append((tuple(all_[:, k].tolist()), split))
        return out


def gains(g, h, total_g, total_h, l2: float):
    """Gain of a split; works on numbers, arrays and columns alike."""
    other_g, other_h = total_g - g, total_h - h
    return g * g / (h + l2) + other_g * other_g / (other_h + l2) - total_g * total_g / (total_h + l2)


# ---- models that fit a task ----


def _grow_in_task(widths: list[int], allowed: dict[str, list[int]], s: Settings):
    def run(group: pa.Table) -> pa.Table:
        name = group.column("model")[0].as_py()
        bins = np.asfortranarray(np.frombuffer(b"".join(group.column("bins").to_pylist()), np.uint8).reshape(group.num_rows, -1))
        y, w = (group.column(c).to_numpy().astype(float) for c in ("y", "w"))
        held = group.column("held").to_numpy(zero_copy_only=False).astype(bool) & (group.num_rows > s.early_rows)
        train = np.flatnonzero(~held)
        histograms = _Histograms(widths, allowed[name], s)
        trained = np.asfortranarray(bins[train])
        quanta = np.rint(w * QUANTUM)
        start = _baseline(float((quanta * y)[train].sum()), float(quanta[train].sum()))
        margin, trees, losses = np.full(group.num_rows, start), [], []
        for _ in range(s.rounds):
            if held.any():
                losses.append(_loss(margin[held], y[held], w[held]) / quanta[held].sum())
                if _stops(losses, s):
                    break
            g, h = _slopes(margin[train], y[train], w[train])
            growing, members, known = Growing(s), {0: np.arange(len(train))}, {}
            while wanted := growing.wanted(ahead=False):
                if wanted == [0]:
                    known[0] = histograms.sums(trained, None, 1, g, h)
                else:
                    # Both children of one node: the smaller one is summed, the other is what is left of the parent.
                    parent = next(k for k, n in enumerate(growing.nodes) if n.children and wanted[0] in n.children)
                    node, rows = growing.nodes[parent], members.pop(parent)
                    left = trained[rows, node.split[1]] <= node.split[2]
                    for child, side in zip(node.children, (rows[left], rows[~left])):
                        members[child] = side
                    small, other = sorted(node.children, key=lambda c: len(members[c]))
                    rows = members[small]
                    known[small] = histograms.sums(trained, None, 1, g[rows], h[rows], rows)
                    known[other] = known.pop(parent) - known[small]
                for i, found in zip(wanted, histograms.best(np.concatenate([known[i] for i in wanted], axis=1))):
                    growing.measure(i, *found)
            trees.append(growing.tree())
            margin += np.array(trees[-1]["value"])[route(trees[-1], bins)]
        return pa.table({"model": [name], "trees": [json.dumps({"baseline": start, "trees": trees})]})

    return run


# ---- models that do not ----


@dataclass
class _Model:
    baseline: float
    allowed: list[int]
    weights: tuple[float, float]  # held-out weight, rows
    trees: list[dict] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    growing: Growing | None = None
    known: dict[int, np.ndarray] = field(default_factory=dict)  # histograms of nodes whose children may be wanted
    done: bool = False


@dataclass
class _Rows:
    """Rows of one model, column by column; the held-out ones come last."""

    model: str
    bins: np.ndarray
    y: np.ndarray
    w: np.ndarray
    margin: np.ndarray
    trained: int

    def moved(self, tree: dict) -> _Rows:
        return replace(self, margin=self.margin + np.array(tree["value"])[route(tree, self.bins)])


def _packed(limit: int):
    """Rows of each model as blocks of at most ``limit`` rows."""
    def block(name: str, parts: list[pa.Table]) -> pa.RecordBatch:
        rows = pa.concat_tables(parts)
        n = rows.num_rows
        bins = np.frombuffer(b"".join(rows.column("bins").to_pylist()), np.uint8).reshape(n, -1)
        y, w, margin = (rows.column(c).to_numpy() for c in ("y", "w", "margin"))
        held = rows.column("held").to_numpy().astype(bool)
        order = np.argsort(held, kind="stable")
        body = pickle.dumps((np.asfortranarray(bins[order]), y[order], w[order], margin[order], int(n - held.sum())), 5)
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([body], pa.binary())], ["model", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[pa.Table]] = {}
        for batch in batches:
            codes = batch.column("model").dictionary_encode()
            index = codes.indices.to_numpy()
            rows = pa.Table.from_batches([batch])
            for k, name in enumerate(codes.dictionary.to_pylist()):
                own = rows.take(pa.array(np.flatnonzero(index == k)))
                while own.num_rows:
                    parts = waiting.setdefault(name, [])
                    room = limit - sum(p.num_rows for p in parts)
                    parts.append(own.slice(0, room))
                    own = own.slice(room)
                    if parts[-1].num_rows == room:
                        yield block(name, waiting.pop(name))
        for name, parts in waiting.items():
            yield block(name, parts)

    return run


def _blocks(table: DataFrame, models: dict[str, _Model]):
    """The rows of all models as an RDD of blocks, dealt evenly to the cores."""
    cores = max(1, table.sparkSession.sparkContext.defaultParallelism)
    rows = sum(m.weights[1] for m in models.values())
    limit = int(min(BLOCK_ROWS, max(1024, rows // (4 * cores))))
    packed = table.select("bins", "y", "w", "held", "model", "margin").mapInArrow(_packed(limit), "model string, body binary")
    return packed.rdd.repartition(cores).map(lambda r: _Rows(r["model"], *pickle.loads(r["body"])))


def _sums_of_nodes(jobs: dict[str, tuple[dict, list[int], list[int]]], widths: list[int], s: Settings):
    """Histograms of the asked nodes, without their empty bins; node -1 has the loss of held-out rows."""
    def run(blocks: Iterator[_Rows]) -> Iterator[tuple[str, int, tuple]]:
        losses: dict[str, float] = {}
        totals: dict[str, np.ndarray] = {}
        layouts = {name: _Histograms(widths, job[2], s) for name, job in jobs.items()}
        for b in blocks:
            if b.model not in jobs:
                continue
            tree, asked, _ = jobs[b.model]
            n = b.trained
            g, h = _slopes(b.margin[:n], b.y[:n], b.w[:n])
            if asked == [0]:
                if n < len(b.y):
                    losses[b.model] = losses.get(b.model, 0.0) + _loss(b.margin[n:], b.y[n:], b.w[n:])
                sums = layouts[b.model].sums(b.bins[:n], None, 1, g, h)
            else:
                node = route(tree, b.bins[:n])
                slots = np.full(len(tree["feature"]), -1, np.int64)
                slots[asked] = np.arange(len(asked))
                slot = slots[node]
                hit = np.flatnonzero(slot >= 0)
                sums = layouts[b.model].sums(b.bins, slot[hit], len(asked), g[hit], h[hit], hit)
            totals[b.model] = totals[b.model] + sums if b.model in totals else sums
        for name, sums in totals.items():
            for k, i in enumerate(jobs[name][1]):
                bins = np.flatnonzero(sums[2, k])
                yield name, i, (bins.astype(np.int32), sums[:, k, bins])
        for name, loss in losses.items():
            yield name, -1, loss

    return run


def _grow_together(table: DataFrame, models: dict[str, _Model], widths: list[int], s: Settings) -> None:
    """Grow the trees of all ``models`` level by level; each step is one job for all of them.

    A step asks for the smaller child of every split that is looked at; the larger one is what is left of the
    parent. What reaches the driver are sums by bin of these nodes, one part a core, whatever the number of rows.
    """
    shared_folder(table.sparkSession)
    layouts = {name: _Histograms(widths, m.allowed, s) for name, m in models.items()}
    state = _blocks(table, models).persist(StorageLevel.MEMORY_AND_DISK)
    older, saved = [], None  # earlier states, to be dropped once the next one is there
    for step in range(s.rounds):
        active = {n: m for n, m in models.items() if not m.done}
        if not active:
            break
        for m in active.values():
            m.growing, m.known = Growing(s), {}
        while True:
            jobs, wanted = {}, {}
            for n, m in active.items():
                if not m.done and (own := m.growing.wanted(ahead=True)):
                    wanted[n] = own
                    jobs[n] = (m.growing.routing(), sorted(_asked(m.growing, own)), m.allowed)
            if not jobs:
                break
            found = {n: np.zeros((3, len(job[1]), layouts[n].total)) for n, job in jobs.items()}
            losses = dict.fromkeys(jobs, 0.0)
            for name, i, part in state.mapPartitions(_sums_of_nodes(jobs, widths, s)).collect():
                if i < 0:
                    losses[name] += part
                else:
                    found[name][:, jobs[name][1].index(i), part[0]] += part[1]
            while older:
                older.pop().unpersist()
            for name, (_, asked, _) in jobs.items():
                m = active[name]
                if asked == [0] and m.weights[0]:
                    m.losses.append(losses[name] / m.weights[0])
                    if _stops(m.losses, s):
                        m.done = True
                        continue
                _learn(m, layouts[name], wanted[name], {i: found[name][:, k] for k, i in enumerate(asked)})
        recent = {}
        for name, m in active.items():
            if not m.done:
                m.trees.append(m.growing.tree())
                recent[name] = m.trees[-1]
        older.append(state)
        state = state.map(_moved(recent)).persist(StorageLevel.MEMORY_AND_DISK)
        if (step + 1) % SEGMENT == 0 and step + 1 < s.rounds:
            state.checkpoint()
            state.count()
            if saved is not None:
                _drop(table, saved)
            saved = state.getCheckpointFile()
    for old in [*older, state]:
        old.unpersist()
    if saved is not None:
        _drop(table, saved)


def _moved(recent: dict[str, dict]):
    return lambda b: b.moved(recent[b.model]) if b.model in recent else b


def _drop(table: DataFrame, path: str) -> None:
    """Delete the checkpoint of a state that a later one has replaced."""
    place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def _asked(growing: Growing, wanted: list[int]) -> set[int]:
    """The root, or the smaller child of every parent of a wanted node."""
    if wanted == [0]:
        return {0}
    return {min(n.children, key=lambda c: growing.nodes[c].totals[2])
            for n in growing.nodes if n.children and not set(n.children).isdisjoint(wanted)}


def _learn(m: _Model, layout: _Histograms, wanted: list[int], found: dict[int, np.ndarray]) -> None:
    """Best splits of the wanted nodes from the histograms that came."""
    m.known |= found
    for parent, node in enumerate(m.growing.nodes):
        if node.children and not set(node.children).isdisjoint(found):
            small, other = node.children if node.children[0] in found else node.children[::-1]
            m.known[other] = m.known.pop(parent) - m.known[small]
    for i, best in zip(wanted, layout.best(np.stack([m.known[i] for i in wanted], axis=1))):
        m.growing.measure(i, *best)
    m.known = {i: x for i, x in m.known.items() if m.growing.nodes[i].split}


# ---- fitting and scoring ----


@dataclass
class Boosters:
    """Fitted models over shared columns."""

    columns: list[str]
    trees: dict[str, Trees]

    def risk(self, model: Column | None = None, values: list[Column] | None = None) -> Column:
        """Probability column; ``model`` names the model of each row (unknown names give null).

        ``values`` stand for the columns where those are not clean numbers themselves.
        """
        trees, width = self.trees, len(self.columns)
        only = next(iter(trees)) if len(trees) == 1 else None

        @F.pandas_udf("double")
        def scored(name: pd.Series, x: pd.Series) -> pd.Series:
            out = np.full(len(x), np.nan)
            for own, at in name.groupby(name).indices.items():
                if own in trees:
                    matrix = np.stack(x.iloc[at].to_list()) if width else np.zeros((len(at), 1))
                    out[at] = 1.0 / (1.0 + np.exp(-trees[own].margins(matrix)))
            return pd.Series(out).where(~np.isnan(out), None)

        values = values or [F.col(c) for c in self.columns] or [F.lit(0.0)]
        return scored(F.lit(only) if model is None else model, F.array(*[v.cast("double") for v in values]))

    def to_json(self) -> str:
        return json.dumps({"columns": self.columns, "trees": {n: asdict(t) for n, t in self.trees.items()}})

    @staticmethod
    def from_json(text: str) -> Boosters:
        body = json.loads(text)
        return Boosters(body["columns"], {n: Trees(**t) for n, t in body["trees"].items()})


def fit_many(rows: DataFrame, columns: list[str], settings: Settings = Settings(), members: str | None = None,
             columns_of: dict[str, list[str]] | None = None, label: str = "y_fail", weight: str | None = None) -> Boosters:
    """Fit all models in one pass structure. ``members`` is a column with the names of the models that a row
    trains (one model named ``model`` without it); ``columns_of`` restricts models to some of ``columns``.

    Columns are numbers without nulls. Models that get no row do not exist in the result.
    """
    values = [F.col(c).cast("double").alias(c) for c in columns]
    held = F.pmod(F.xxhash64(*columns, F.col(label)), F.lit(10)) == 0
    names = F.array(F.lit("model")) if members is None else F.col(members)
    source = reuse(rows.select(*values, F.col(label).cast("double").alias("y"),
                               (F.lit(1.0) if weight is None else F.col(weight)).cast("double").alias("w"),
                               held.alias("held"), names.alias("models")))
    edges = bin_edges(source, columns)
    widths = [len(e) + 1 for e in edges]
    table = reuse(source.mapInArrow(_binned(columns, edges), "bins binary, y double, w double, held boolean, models array<string>")
                  .withColumn("model", F.explode("models")).drop("models"))
    quanta = F.rint(F.col("w") * QUANTUM)
    sizes = table.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.when(F.col("held") == h, x)).alias(f"{name}{int(h)}") for h in (False, True)
          for name, x in (("pos", quanta * F.col("y")), ("all", quanta))]).collect()  # a row a model
    allowed = {r["model"]: sorted(columns.index(c) for c in (columns_of or {}).get(r["model"], columns)) for r in sizes}
    found: dict[str, tuple[float, list[dict]]] = {}
    most = min(TASK_ROWS, TASK_CELLS // max(1, len(columns)))
    small = [r["model"] for r in sizes if r["n"] <= most]
    if small:
        fitted = table.where(F.col("model").isin(small)).groupBy("model").applyInArrow(
            _grow_in_task(widths, allowed, settings), "model string, trees string")
        for r in fitted.collect():  # models are bounded by rounds and leaves
            body = json.loads(r["trees"])
            found[r["model"]] = (body["baseline"], body["trees"])
    large = {}
    for r in sizes:
        if r["n"] > most:
            early = r["n"] > settings.early_rows
            pos, all_ = ((r["pos0"] or 0) + (0 if early else r["pos1"] or 0), (r["all0"] or 0) + (0 if early else r["all1"] or 0))
            large[r["model"]] = _Model(_baseline(pos, all_), allowed[r["model"]], (r["all1"] or 0 if early else 0.0, r["n"]))
    if large:
        start = F.create_map(*[F.lit(x) for n, m in large.items() for x in (n, m.baseline)])
        early = F.col("model").isin([n for n, m in large.items() if m.weights[0]])
        spread = table.where(F.col("model").isin(list(large))).withColumn(
            "held", F.col("held") & early).withColumn("margin", start[F.col("model")])
        _grow_together(spread, large, widths, settings)
        found |= {n: (m.baseline, m.trees) for n, m in large.items()}
    out = {}
    for name, (baseline, trees) in found.items():
        out[name] = Trees(baseline)
        for t in trees:
            out[name].add(t, edges)
    return Boosters(columns, out)
