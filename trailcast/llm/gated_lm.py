"""Gated recurrent language model with a class-factored output, trained and applied in numpy under Spark.

Counts cover every training token: words are 64-bit hashes that Spark sums by hash slices. The
recurrent weights are fitted by truncated backpropagation: each task of a round walks through its
share of the training documents from the common weights, and the weights are averaged. Scoring
carries the state across windows to the end of each document.

A token's probability is that of its class given the state times that of the token in its class.
The MODEL_WORDS commonest words have classes of GROUP words and a softmax over them. All other
words have a class by their last two bytes, and inside it (count + 0.1) out of the class's sum,
where all unseen words of the class share one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trailcast.llm import common

#: Words with counts that are broadcast, at most (2 MB); the counts of all others are joined.
LEXICON = 1 << 17
#: Words with an own output; words of one output class; classes of all other words.
MODEL_WORDS, GROUP, TAIL_CLASSES = 1024, 32, 64
HIDDEN = 32
#: Rounds of averaging; the rounds together walk once through all training documents.
ROUNDS = 4
#: Documents side by side and steps of a window of truncated backpropagation; Adagrad's rate.
STREAMS, STEPS, RATE = 16, 24, 0.08
#: Documents side by side and tokens of a window while scoring; bytes of text scored at once.
SIDE, WINDOW_TOKENS, SCORE_BYTES = 512, 1 << 14, 1 << 24
#: Tokens that a counting task gathers before it hands counts on.
FLUSH = 1 << 21
#: Training tokens that one slice of the counts covers, about.
PER_SLICE = 1 << 22
#: Added to every count.
SMOOTH = 0.1

END = np.uint64(0x1F83D9ABFB41BD6B)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 10; a row without id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(10)) == 0, F.lit(False))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-case words of all texts, each text closed by END; tail classes; bounds of texts."""
    data, offsets = common.buffers(texts)
    hashes, classes, counts = [], [], []
    for start, end in common.pieces(offsets):
        part = common.lowered(data[offsets[start]:offsets[end]])
        starts, ends, bounds = common.word_bounds(part, offsets[start:end + 1] - offsets[start])
        if len(starts):
            before = np.where(ends - starts > 1, part[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
            tail = common.mix(part[ends - 1].astype(np.uint64) * np.uint64(256) + before) % np.uint64(TAIL_CLASSES)
        else:
            tail = np.zeros(0, np.uint64)
        hashes.append(np.insert(common.word_hashes(part, starts, ends), bounds[1:], END))
        classes.append(np.insert(tail.astype(np.uint8), bounds[1:], 0))
        counts.append(np.diff(bounds) + 1)
    if not counts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return np.concatenate(hashes), np.concatenate(classes), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


# ---- counts ----

_COUNT = np.dtype([("word", np.uint64), ("n", np.int64), ("tail", np.uint8)])


def _summed(words: np.ndarray, n: np.ndarray, tail: np.ndarray) -> np.ndarray:
    order = np.argsort(words, kind="stable")
    words = words[order]
    start = np.flatnonzero(np.append(True, words[1:] != words[:-1])) if len(words) else np.zeros(0, np.int64)
    out = np.empty(len(start), _COUNT)
    out["word"], out["tail"] = words[start], tail[order][start]
    out["n"] = np.add.reduceat(n[order], start) if len(start) else 0
    return out


def _by_slice(words: np.ndarray, slices: int) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of the words of each slice."""
    of = (words % np.uint64(slices)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[order], np.arange(slices + 1))
    for s in np.flatnonzero(np.diff(edges)):
        yield int(s), order[edges[s]:edges[s + 1]]


def _count(slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            words = np.concatenate([h for h, _ in held])
            table = _summed(words, np.ones(len(words), np.int64), np.concatenate([t for _, t in held]))
            parts = list(_by_slice(table["word"], slices))
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in parts], pa.int64()),
                                               pa.array([table[at].tobytes() for _, at in parts], pa.binary())],
                                              ["slice", "counts"])

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                words, tail, _ = tokens(batch.column(0).slice(start, 256))
                held.append((words, tail))
                size += len(words)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _total(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.empty(0, _COUNT)
    for batch in batches:
        parts = [total, *(np.frombuffer(x, _COUNT) for x in batch.column("counts").to_pylist())]
        parts = np.concatenate(parts)
        total = _summed(parts["word"], parts["n"], parts["tail"])
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())],
                                     ["slice", "counts"])


_GRID = np.unique(np.floor(1.1 ** np.arange(0, 480)).astype(np.float64))


def _overview(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers by kind: tokens and words in all, by tail class, and words of at least each count of the grid."""
    for batch in batches:
        for payload in batch.column(0).to_pylist():
            table = np.frombuffer(payload, _COUNT)
            own = table[table["word"] != END]
            kinds = ["all"] + ["tail"] * TAIL_CLASSES + ["least"] * len(_GRID)
            at = np.concatenate([[0], np.arange(TAIL_CLASSES), np.arange(len(_GRID))])
            ordered = np.sort(table["n"])
            n = np.concatenate([[table["n"].sum()], np.bincount(own["tail"], weights=own["n"], minlength=TAIL_CLASSES),
                                len(ordered) - np.searchsorted(ordered, _GRID)])
            words = np.concatenate([[len(table)], np.bincount(own["tail"], minlength=TAIL_CLASSES), np.zeros(len(_GRID))])
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(at, pa.int64()), pa.array(n.astype(np.int64)),
                                              pa.array(words.astype(np.int64))], ["kind", "at", "n", "words"])


def _common_words(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                table = np.frombuffer(payload, _COUNT)
                table = table[(table["n"] >= least) | (table["word"] == END)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(table["word"]).view(np.int64)),
                                                  pa.array(np.ascontiguousarray(table["n"])),
                                                  pa.array(table["tail"].astype(np.int32))], ["word", "n", "tail"])

    return run


@dataclass
class Counts:
    """What all training tokens say: totals, the common words (sorted by hash), sums of tail classes."""

    tokens: int
    distinct: int
    words: np.ndarray
    n: np.ndarray
    model_index: np.ndarray  # of the common words: place among the model's words, or -1
    model_words: int
    model_n: np.ndarray
    tail_log10: np.ndarray  # log10 of each tail class's sum

    @property
    def denominator(self) -> float:
        return self.tokens + SMOOTH * (self.distinct + 1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each word among the common ones, or -1."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)


def count(training: DataFrame) -> tuple[Counts, DataFrame, int]:
    """Counts of the words of ``text``; the table of all counts by slice; the number of slices."""
    size = training.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    slices = common.tasks(training.sparkSession, size[0] / 6 + size[1], PER_SLICE)
    table = common.write_table(training.select("text").mapInArrow(_count(slices), "slice long, counts binary")
                               .groupBy("slice").applyInArrow(_total, "slice long, counts binary"))
    view = table.select("counts").mapInArrow(_overview, "kind string, at long, n long, words long").groupBy("kind", "at").agg(
        F.sum("n").alias("n"), F.sum("words").alias("words")).toPandas()
    tail_n, tail_words = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    part = view[view["kind"] == "tail"]
    tail_n[part["at"]], tail_words[part["at"]] = part["n"], part["words"]
    everything = view[view["kind"] == "all"]
    above = view[(view["kind"] == "least") & (view["n"] <= LEXICON)]
    least = int(_GRID[int(above["at"].min())]) if len(above) else 1
    common_words = table.select("counts").mapInArrow(_common_words(least), "word long, n long, tail int").toPandas()
    words = common_words["word"].to_numpy(np.int64).view(np.uint64)
    n, tail = common_words["n"].to_numpy(np.int64), common_words["tail"].to_numpy(np.int64)
    if END not in words:
        words, n, tail = np.append(words, END), np.append(n, 0), np.append(tail, 0)
    order = np.argsort(words)
    words, n, tail = words[order], n[order], tail[order]
    # The end of a text always is a word of the model.
    ranked = np.lexsort((words, -n, words != END))[:MODEL_WORDS]
    ranked = np.concatenate([ranked[:1], ranked[1:][np.argsort(-n[ranked[1:]], kind="stable")]])
    index = np.full(len(words), -1)
    index[ranked] = np.arange(len(ranked))
    ordinary = ranked[1:]
    tail_n -= np.bincount(tail[ordinary], weights=n[ordinary], minlength=TAIL_CLASSES)
    tail_words -= np.bincount(tail[ordinary], minlength=TAIL_CLASSES)
    counts = Counts(int(everything["n"].sum()), int(everything["words"].sum()), words, n, index, len(ranked), n[ranked],
                    np.log10(tail_n + SMOOTH * (tail_words + 1)))
    return counts, table, slices


# ---- the network ----


class Network:
    """Weights of the gated recurrent network; all float32, in one dictionary."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights
        self.words = len(weights["word_bias"])
        self.groups = -(-self.words // GROUP)

    @classmethod
    def start(cls, counts: Counts) -> Network:
        """Weights whose output is the unigram distribution of the classes and words."""
        rng = np.random.default_rng(3)
        k = counts.model_words
        groups = -(-k // GROUP)
        smooth = counts.model_n + SMOOTH
        sums = np.add.reduceat(smooth, np.arange(0, k, GROUP))
        classes = np.concatenate([sums, 10.0 ** counts.tail_log10])
        draw = lambda *shape: rng.standard_normal(shape).astype(np.float32)
        return cls({
            "inputs": draw(k + TAIL_CLASSES, 3 * HIDDEN) * np.float32(0.3),
            "state": draw(HIDDEN, 3 * HIDDEN) * np.float32(0.5 / math.sqrt(HIDDEN)),
            "class": draw(HIDDEN, groups + TAIL_CLASSES) * np.float32(0.01),
            "class_bias": np.log(classes / classes.sum()).astype(np.float32),
            "word": draw(k, HIDDEN) * np.float32(0.01),
            "word_bias": np.log(smooth / sums[np.arange(k) // GROUP]).astype(np.float32)})

    def steps(self, ids: np.ndarray, state: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States after each input of (steps, streams)."""
        gates_in, u = self.w["inputs"][ids], self.w["state"]
        out = np.empty((len(ids), *state.shape), np.float32)
        h2 = 2 * HIDDEN
        for t in range(len(ids)):
            own = state @ u
            zr = gates_in[t, :, :h2] + own[:, :h2]
            np.multiply(zr, np.float32(0.5), out=zr)
            np.tanh(zr, out=zr)
            zr += np.float32(1)
            zr *= np.float32(0.5)
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(gates_in[t, :, h2:] + r * own[:, h2:])
            if trace is not None:
                trace.append((state, z, r, own[:, h2:], new))
            state = new + z * (state - new)
            out[t] = state
        return out

    def classes(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.words, ids // GROUP, self.groups + ids - self.words)

    def log_prob(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural log of each target's class, and of the word in its class for words of the model."""
        logits = states @ self.w["class"]
        logits += self.w["class_bias"]
        wanted = self.classes(ids)
        out = logits[np.arange(len(ids)), wanted] - _log_sum(logits, _reach(self.w["class"].T, self.w["class_bias"]))
        reach = _reach(self.w["word"], self.w["word_bias"])
        for g, at in _grouped(wanted, self.groups):
            first = g * GROUP
            inner = states[at] @ self.w["word"][first:first + GROUP].T
            inner += self.w["word_bias"][first:first + GROUP]
            out[at] += inner[np.arange(len(at)), ids[at] - first] - _log_sum(inner, reach)
        return out

    def by_group(self) -> tuple[np.ndarray, np.ndarray]:
        """Output weights and biases of the model's words by class; a class that is not full ends in impossible words."""
        missing = self.groups * GROUP - self.words
        weights, bias = self.w["word"], self.w["word_bias"]
        if missing:
            weights = np.concatenate([weights, np.zeros((missing, HIDDEN), np.float32)])
            bias = np.append(bias, np.full(missing, -np.inf, np.float32))
        return weights.reshape(self.groups, GROUP, HIDDEN), bias.reshape(self.groups, GROUP)

    def gradients(self, ids: np.ndarray, targets: np.ndarray, mask: np.ndarray,
                  state: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Gradients of the mean negative log probability over a window, the inputs that they change, the state after it."""
        trace: list = []
        states = self.steps(ids, state, trace)
        after = states[-1]
        used = np.flatnonzero(mask.ravel())
        flat, wanted_ids = states.reshape(-1, HIDDEN)[used], targets.ravel()[used]
        scale = np.float32(1.0 / max(1, len(used)))
        logits = flat @ self.w["class"] + self.w["class_bias"]
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        wanted = self.classes(wanted_ids)
        p[np.arange(len(used)), wanted] -= 1
        p *= scale
        g = {"class": flat.T @ p, "class_bias": p.sum(axis=0)}
        d_flat = p @ self.w["class"].T
        # Words inside their classes: targets in order of their class, each with the weights of its class.
        at = np.argsort(wanted, kind="stable")[:np.count_nonzero(wanted < self.groups)]
        group, own = wanted[at], flat[at]
        weights, bias = self.by_group()
        d_word, d_bias = np.zeros_like(weights), np.zeros_like(bias)
        if len(at):
            near = weights[group]
            q = np.matmul(near, own[:, :, None])[:, :, 0] + bias[group]
            q -= q.max(axis=1, keepdims=True)
            np.exp(q, out=q)
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(len(at)), wanted_ids[at] - group * GROUP] -= 1
            q *= scale
            d_flat[at] += np.matmul(q[:, None, :], near)[:, 0]
            edges = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(at))
            for a, b in zip(edges[:-1], edges[1:]):
                d_word[group[a]] = q[a:b].T @ own[a:b]
            d_bias[group[edges[:-1]]] = np.add.reduceat(q, edges[:-1], axis=0)
        g["word"], g["word_bias"] = d_word.reshape(-1, HIDDEN)[:self.words], d_bias.ravel()[:self.words]
        d_states = np.zeros((ids.size, HIDDEN), np.float32)
        d_states[used] = d_flat
        d_states = d_states.reshape(*ids.shape, HIDDEN)
        # All that does not depend on later steps is computed for the whole window.
        before, z, r, inner, new = (np.stack(x) for x in zip(*trace))
        to_new = (1 - z) * (1 - new * new)
        to_gates = np.concatenate([(before - new) * z * (1 - z), to_new * inner * r * (1 - r), to_new, to_new * r], axis=2)
        d_all = np.empty((*ids.shape, 4 * HIDDEN), np.float32)
        to_gates = to_gates.reshape(*ids.shape, 4, HIDDEN)
        carry = np.zeros_like(state)
        back = np.concatenate([self.w["state"][:, :2 * HIDDEN], np.zeros((HIDDEN, HIDDEN), np.float32),
                               self.w["state"][:, 2 * HIDDEN:]], axis=1).T
        for t in range(len(ids) - 1, -1, -1):
            d = d_states[t] + carry
            np.multiply(to_gates[t], d[:, None, :], out=d_all[t].reshape(-1, 4, HIDDEN))
            carry = d_all[t] @ back
            d *= z[t]
            carry += d
        flat_all = d_all.reshape(-1, 4 * HIDDEN)
        d_inputs = flat_all[:, :3 * HIDDEN]
        to_state = before.reshape(-1, HIDDEN).T @ flat_all
        g["state"] = np.concatenate([to_state[:, :2 * HIDDEN], to_state[:, 3 * HIDDEN:]], axis=1)
        # Of the input table only the rows that occur.
        order = np.argsort(ids, axis=None, kind="stable")
        rows = ids.ravel()[order]
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        g["inputs"] = np.add.reduceat(d_inputs[order], first, axis=0)
        return g, rows[first], after


#: Logits within this reach of 0 keep the sum of their powers of e inside float32.
SAFE = 60.0


def _reach(weights: np.ndarray, bias: np.ndarray) -> float:
    """The largest size of a logit: states lie between -1 and 1."""
    return float((np.abs(weights).sum(axis=1) + np.abs(bias)).max(initial=0.0))


def _log_sum(logits: np.ndarray, reach: float) -> np.ndarray:
    """Log of the sum of exp of each row; rows are shifted by their largest value only if exp could overflow."""
    ones = np.ones(logits.shape[1], np.float32)
    if reach < SAFE:
        return np.log(np.exp(logits) @ ones)
    top = logits.max(axis=1)
    logits = logits - top[:, None]
    return top + np.log(np.exp(logits, out=logits) @ ones)


def _grouped(wanted: np.ndarray, groups: int) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of the targets of each class of model words."""
    order = np.argsort(wanted, kind="stable")
    edges = np.searchsorted(wanted[order], np.arange(groups + 1))
    for k in np.flatnonzero(np.diff(edges)):
        yield int(k), order[edges[k]:edges[k + 1]]


def _model_ids(counts: Counts, hashes: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the network for each token, and places among the common words."""
    place = counts.find(hashes)
    index = np.where(place >= 0, counts.model_index[place], -1)
    return np.where(index >= 0, index, counts.model_words + tail.astype(np.int64)), place


# ---- training ----


def _train(shared):
    """Walk through the documents of a task from the common weights; one row with the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, weights, squares = shared.value
        network = Network({k: v.copy() for k, v in weights.items()})
        squares = {k: v.copy() for k, v in squares.items()}
        queue: list[np.ndarray] = []
        streams: list[np.ndarray] = [np.zeros(0, np.int64)] * STREAMS
        state = np.zeros((STREAMS, HIDDEN), np.float32)
        seen = 0

        def window() -> int:
            ids, targets = np.zeros((STEPS, STREAMS), np.int64), np.zeros((STEPS, STREAMS), np.int64)
            mask = np.zeros((STEPS, STREAMS), bool)
            for s in range(STREAMS):
                if len(streams[s]) < 2 and queue:
                    streams[s] = np.append(0, queue.pop())  # a text follows an end
                    state[s] = 0
                n = min(STEPS, len(streams[s]) - 1)
                if n > 0:
                    ids[:n, s], targets[:n, s], mask[:n, s] = streams[s][:n], streams[s][1:n + 1], True
                    streams[s] = streams[s][n:]
            if not mask.any():
                return 0
            g, rows, after = network.gradients(ids, targets, mask, state.copy())
            state[:] = after
            norm = math.sqrt(sum(float(np.vdot(x, x)) for x in g.values()))
            for name, x in g.items():
                if norm > 1:
                    x /= np.float32(norm)
                at = rows if name == "inputs" else slice(None)
                power = squares[name][at] + x * x
                squares[name][at] = power
                x *= np.float32(RATE)
                network.w[name][at] -= x / np.sqrt(power)
            return int(mask.sum())

        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                hashes, tail, bounds = tokens(batch.column(0).slice(start, 64))
                ids, _ = _model_ids(counts, hashes, tail)
                queue.extend(ids[a:b] for a, b in zip(bounds[:-1], bounds[1:]))
                while len(queue) >= STREAMS:
                    seen += window()
        while n := window():
            seen += n
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([seen], pa.int64()), pa.array([_flat(network.w, seen)], pa.binary()),
                 pa.array([_flat(squares, seen)], pa.binary())], ["n", "weights", "squares"])

    return run


def _flat(arrays: dict[str, np.ndarray], times: float) -> bytes:
    return (np.concatenate([arrays[k].ravel() for k in sorted(arrays)]).astype(np.float64) * times).tobytes()


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at:at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, weights, squares = 0, 0.0, 0.0
    for batch in batches:
        for k in range(batch.num_rows):
            n += batch.column("n")[k].as_py()
            weights = weights + np.frombuffer(batch.column("weights")[k].as_py())
            squares = squares + np.frombuffer(batch.column("squares")[k].as_py())
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([weights.tobytes()], pa.binary()),
                                      pa.array([squares.tobytes()], pa.binary())], ["n", "weights", "squares"])


def fit(training: DataFrame, counts: Counts, rounds: int = ROUNDS) -> Network:
    """Average, over tasks and in rounds, of networks trained on disjoint shares of the documents.

    Each document of (doc_id, text) is in the share of one round, by its doc_id (without one, by its
    text), so copies of a text spread over the rounds. Sums of weights are added up by Spark before
    they reach the driver.
    """
    network = Network.start(counts)
    squares = {k: np.full_like(v, 1e-4) for k, v in network.w.items()}
    spark = training.sparkSession
    schema = "n long, weights binary, squares binary"
    turn = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(rounds))
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((counts, network.w, squares))
        parts = training.where(turn == k).select("text").mapInArrow(_train(shared), schema)
        adders = max(1, math.isqrt(parts.rdd.getNumPartitions()))
        sums = parts.groupBy(F.pmod(F.spark_partition_id(), F.lit(adders)).alias("part")).applyInArrow(_add, schema).toPandas()
        if len(sums):
            n = int(sums["n"].sum())
            flat = [sum(np.frombuffer(x) for x in sums[c]) / n for c in ("weights", "squares")]
            network = Network(_shaped(flat[0], network.w))
            squares = _shaped(flat[1], squares)
        shared.unpersist()
    return network


# ---- scoring ----


def _log_probs(network: Network, documents: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each document's ids, the state carried from window to window."""
    out = np.zeros(len(documents))
    order = sorted(range(len(documents)), key=lambda k: -len(documents[k]))
    for start in range(0, len(order), SIDE):
        side = order[start:start + SIDE]
        lengths = np.array([len(documents[k]) for k in side])
        state = np.zeros((len(side), HIDDEN), np.float32)
        at = 0
        before = np.zeros(len(side), np.int64)  # a text follows an end
        while at < lengths[0]:
            live = int(np.searchsorted(-lengths, -at, side="left"))
            steps = int(min(max(1, WINDOW_TOKENS // live), lengths[0] - at))
            targets = np.full((steps, live), -1)
            for k in range(live):
                part = documents[side[k]][at:at + steps]
                targets[:len(part), k] = part
            ids = np.concatenate([before[None, :live], np.maximum(targets[:-1], 0)])
            states = network.steps(ids, state[:live])
            mask = targets.ravel() >= 0
            said = network.log_prob(states.reshape(-1, HIDDEN)[mask], targets.ravel()[mask])
            owner = np.tile(np.arange(live), steps)[mask]
            sums = np.bincount(owner, weights=said, minlength=live)
            for k in range(live):
                out[side[k]] += sums[k]
            state = states[-1]
            before = np.maximum(targets[-1], 0)
            at += steps
    return out


def _score(shared):
    """Of each document: tokens, sums over common words and model, and its other words for the join with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, network = shared.value
        log_n = np.log10(counts.n + SMOOTH)
        for batch in batches:
            _, offsets = common.buffers(batch.column("text"))
            for start, end in common.pieces(offsets, SCORE_BYTES):
                part = batch.slice(start, end - start)
                hashes, tail, bounds = tokens(part.column("text"))
                ids, place = _model_ids(counts, hashes, tail)
                lengths = np.diff(bounds)
                owner = np.repeat(np.arange(part.num_rows), lengths)
                total = lambda x: np.bincount(owner, weights=x, minlength=part.num_rows)
                known = place >= 0
                log_count = np.where(known, log_n[place], 0.0)
                outside = ids >= network.words
                inside_class = np.where(outside, log_count - counts.tail_log10[np.where(outside, ids - network.words, 0)], 0.0)
                model = _log_probs(network, [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]) / math.log(10)
                rare, rare_n = [], []
                unknown = hashes[~known]
                edges = np.concatenate([[0], np.cumsum(np.bincount(owner[~known], minlength=part.num_rows))])
                for a, b in zip(edges[:-1], edges[1:]):
                    words, n = np.unique(unknown[a:b], return_counts=True)
                    rare.append(words.tobytes())
                    rare_n.append(n.astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), part.column("held_out"), pa.array(lengths),
                     pa.array(total(known & (counts.n[place] > 0)).astype(np.int64)), pa.array(total(log_count)),
                     pa.array(model + total(inside_class)), pa.array(rare, pa.binary()), pa.array(rare_n, pa.binary())],
                    ["row", "doc_id", "held_out", "n_tokens", "n_common", "base", "model", "rare", "rare_n"])

    return run


_RARE = np.dtype([("row", np.int64), ("word", np.uint64), ("n", np.int32)])
_SUM = np.dtype([("row", np.int64), ("log_count", np.float64), ("known", np.int64)])
#: Rows whose sums travel together.
SUM_ROWS = 4096


def _spread(slices: int):
    """Rare words of documents, by slice of the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                rows = part.column("row").to_numpy(zero_copy_only=False)
                words = [np.frombuffer(x, np.uint64) for x in part.column("rare").to_pylist()]
                n = [np.frombuffer(x, np.int32) for x in part.column("rare_n").to_pylist()]
                entries = np.empty(sum(map(len, words)), _RARE)
                if not len(entries):
                    continue
                entries["row"] = np.repeat(rows, [len(w) for w in words])
                entries["word"], entries["n"] = np.concatenate(words), np.concatenate(n)
                parts = list(_by_slice(entries["word"], slices))
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in parts], pa.int64()),
                                                  pa.array([entries[at].tobytes() for _, at in parts], pa.binary())],
                                                 ["slice", "words"])

    return run


def _rare_sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums of a slice's words for each document (log10 of count + SMOOTH, how many are known), by blocks of rows."""
    entries = np.concatenate([np.zeros(0, _RARE), *(np.frombuffer(x, _RARE) for x in left.column("words").to_pylist())])
    counts = np.concatenate([np.zeros(0, _COUNT), *(np.frombuffer(x, _COUNT) for x in right.column("counts").to_pylist())])
    n = np.zeros(len(entries), np.int64)
    if len(counts):
        at = np.minimum(np.searchsorted(counts["word"], entries["word"]), len(counts) - 1)
        n = np.where(counts["word"][at] == entries["word"], counts["n"][at], 0)
    rows, owner = np.unique(entries["row"], return_inverse=True)
    sums = np.empty(len(rows), _SUM)
    sums["row"] = rows
    sums["log_count"] = np.bincount(owner, weights=np.log10(n + SMOOTH) * entries["n"], minlength=len(rows))
    sums["known"] = np.bincount(owner, weights=(n > 0) * entries["n"], minlength=len(rows))
    block = rows // SUM_ROWS
    edges = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block)) if len(block) else np.zeros(1, int)
    return pa.table({"block": pa.array(block[edges[:-1]], pa.int64()),
                     "sums": pa.array([sums[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())})


def _row_sums(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over all slices, one row for each document of a block."""
    sums = np.concatenate([np.frombuffer(x, _SUM) for batch in batches for x in batch.column("sums").to_pylist()])
    rows, owner = np.unique(sums["row"], return_inverse=True)
    yield pa.RecordBatch.from_arrays(
        [pa.array(rows), pa.array(np.bincount(owner, weights=sums["log_count"])),
         pa.array(np.bincount(owner, weights=sums["known"]).astype(np.int64))], ["row", "log_count", "known"])


def score(docs: DataFrame, counts: Counts, network: Network, table: DataFrame, slices: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of rows of (doc_id, held_out, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((counts, network))  # bounded by LEXICON and MODEL_WORDS
    kind = dict(docs.dtypes)["doc_id"]
    said = common.write_table(common.with_row_id(docs.select("doc_id", "held_out", "text"), "row").mapInArrow(
        _score(shared), f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_common long, base double, "
                        "model double, rare binary, rare_n binary"))
    rare = said.select("row", "rare", "rare_n").mapInArrow(_spread(slices), "slice long, words binary")
    sums = rare.groupBy("slice").cogroup(table.groupBy("slice")).applyInArrow(
        _rare_sums, "block long, sums binary").groupBy("block").applyInArrow(
        _row_sums, "row long, log_count double, known long")
    rest = F.coalesce("log_count", F.lit(0.0))
    return said.drop("rare", "rare_n").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_common") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + rest - F.col("n_tokens") * F.lit(math.log10(counts.denominator))).alias("base_score"),
        (F.col("model") + rest).alias("score"))


def score_held_out(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out and score all of (doc_id, text).

    Null texts are empty: one token, the end. Repeated rows count and are scored each; a null doc_id
    trains. An empty table gives an empty result; without training documents all words are unseen.
    Other columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    training = rows.where("not held_out")
    counts, table, slices = count(training)
    return score(rows, counts, fit(training, counts), table, slices)
