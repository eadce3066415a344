"""Features of each arriving step from keyed state, in constant work per step.

Text is read by :func:`trailcast.operators.step_signals.step_signals` on the stream
itself (a map in the JVM); the processor only updates counters. Steps may arrive late,
twice or in any order: a step waits in state until all earlier ones are there, and a
number seen before is dropped. With ``wait`` a step that never comes does not hold its
run for ever: an event-time timer of the first step beyond it goes on without it and
marks the gap.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trailcast.functions import patterns as P
from trailcast.operators.features import BASE_FEATURES
from trailcast.operators.step_signals import step_signals, with_defaults
from trailcast.streaming import step_dynamics as SD

RATIOS = {"avg_observation_chars", "edit_to_read_ratio", "test_to_edit_ratio", "search_to_edit_ratio"}
OUTPUT = "trajectory_id string, prefix_step bigint, " + ", ".join(
    f"{n} {'double' if n in RATIOS else 'bigint'}" for n in BASE_FEATURES if n != "prefix_step")
EXTRAS = "recent_commands array<string>, gap bigint, n_missing bigint"
SIGNALS = ["k", "kind", "files", "cmd", "shown_cmd", "is_test", "has_action", "thought_len", "action_len", "obs_len",
           "passes", "fails", "test_code", "traceback", "assertion"]


# A step crosses to the processor as one JSON text and its features come back as one CSV text: Spark converts
# rows for Python value by value.
PACKED = "trajectory_id string, numbers string, recent_commands array<string>"


def output_schema(dynamics: bool) -> str:
    return ", ".join([OUTPUT, *([SD.SCHEMA] if dynamics else []), EXTRAS])


def numbers_schema(dynamics: bool) -> str:
    """What the CSV text holds: all of the output but the run and its commands."""
    return ", ".join(n for n in output_schema(dynamics).split(", ") if not n.startswith(("trajectory_id ", "recent_commands ")))


#: Counts and early steps of a run that lie in its one value; with more of them all go to map state, by key.
FEW = 1000
FEW_WAITING = 250


class _Table:
    """A keyed count table, in the run's value while small (``few``), then in map state (``few`` is None).

    Values touched in one call are read and written once.
    """

    def __init__(self, few: dict | None, state):
        self.few, self.state, self.seen = few, state, {}

    def add(self, key: str) -> int:
        if self.few is not None:
            self.few[key] = n = self.few.get(key, 0) + 1
            return n
        if key not in self.seen:
            stored = self.state.getValue((key,))
            self.seen[key] = int(stored[0]) if stored else 0
        self.seen[key] += 1
        return self.seen[key]

    def get(self, key: str) -> int:
        if self.few is not None:
            return self.few.get(key, 0)
        if key in self.seen:
            return self.seen[key]
        stored = self.state.getValue((key,))
        return int(stored[0]) if stored else 0

    def keep(self, key: str, value: float) -> None:
        """A number that is no count."""
        if self.few is not None:
            self.few[key] = value
        else:
            self.state.updateValue((key,), (repr(value),))

    def kept(self, key: str, forget: bool) -> float | None:
        if self.few is not None:
            return self.few.pop(key, None) if forget else self.few.get(key)
        stored = self.state.getValue((key,))
        if stored and forget:
            self.state.removeKey((key,))
        return float(stored[0]) if stored else None

    def save(self) -> dict | None:
        """Write what the run's value does not hold; returns what it holds."""
        if self.few is not None and len(self.few) <= FEW:
            return self.few
        for key, n in (self.seen if self.few is None else self.few).items():
            self.state.updateValue((key,), (repr(n),))
        return None


class _Waiting:
    """Early steps by number, in the run's value while few, then in map state (``few`` is None)."""

    def __init__(self, few: dict | None, state):
        self.few, self.state, self.order = few, state, None

    def pop(self, k: int) -> str | None:
        if self.few is not None:
            return self.few.pop(str(k), None)
        if not self.state.containsKey((k,)):
            return None
        step = self.state.getValue((k,))[0]
        self.state.removeKey((k,))
        return step

    def add(self, steps: dict[int, str]) -> None:
        """Keep steps; one that waits already stays as it is."""
        if self.few is not None:
            self.few = {str(k): step for k, step in steps.items()} | self.few
            if len(self.few) <= FEW_WAITING:
                return
            steps, self.few = {int(k): step for k, step in self.few.items()}, None
        for k, step in steps.items():
            if not self.state.containsKey((k,)):
                self.state.updateValue((k,), (step,))
        self.order = None

    def first(self, after: int) -> tuple[int, str] | None:
        """The first waiting step; all of them come after ``after``."""
        if self.few is not None:
            k = min(map(int, self.few), default=None)
            return None if k is None else (k, self.few[str(k)])
        if self.order is None:
            self.order = sorted((k for (k,) in self.state.keys()), reverse=True)
        while self.order and self.order[-1] <= after:
            self.order.pop()
        if not self.order:
            self.few = {}
            return None
        return self.order[-1], self.state.getValue((self.order[-1],))[0]


class StepFeatures(StatefulProcessor):
    """Counters of a run in one value; many keyed counts in a map, many early steps in another."""

    def __init__(self, ttl_ms: int | None = None, dynamics: bool = False, similarity: str = "blocks", wait_ms: int | None = None):
        self.ttl_ms, self.dynamics, self.similarity, self.wait_ms = ttl_ms, dynamics, similarity, wait_ms
        self.signals = SIGNALS + (SD.SIGNALS if dynamics else []) + (["at_ms"] if wait_ms is not None else [])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", "body string", self.ttl_ms)
        self.counts = handle.getMapState("counts", "key string", "n string", self.ttl_ms)
        self.waiting = handle.getMapState("waiting", "k bigint", "body string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        c, table, waiting = self._state()
        arrived = {}
        for r in rows:
            if r.k > c["k"]:
                arrived.setdefault(r.k, r.body)
        results = self._go_on(key, c, table, waiting, arrived)
        if arrived:
            waiting.add(arrived)
        if self.wait_ms is not None:
            results += self._pass_gaps(key, c, table, waiting, timerValues.getCurrentWatermarkInMs())
        self._store(c, table, waiting)
        return iter(results)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        c, table, waiting = self._state()
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        results = self._pass_gaps(key, c, table, waiting, now)
        self._store(c, table, waiting)
        return iter(results)

    def close(self) -> None:
        pass

    def _state(self) -> tuple[dict, _Table, _Waiting]:
        stored = self.counters.get()
        c = json.loads(stored[0]) if stored else {
            "k": 0, "recent": [], "shown": [], "kind": None, "streak": 0, "missing": 0, "counts": {}, "waiting": {}}
        return c, _Table(c.get("counts"), self.counts), _Waiting(c.get("waiting"), self.waiting)

    def _store(self, c: dict, table: _Table, waiting: _Waiting) -> None:
        c["counts"], c["waiting"] = table.save(), waiting.few
        self.counters.update((json.dumps(c),))

    def _go_on(self, key, c: dict, table: _Table, waiting: _Waiting, arrived: dict[int, str]) -> list[Row]:
        """All steps that follow without a gap, from what arrived and what waits."""
        results = []
        while True:
            k = c["k"] + 1
            held = waiting.pop(k)
            step = arrived.pop(k, held)
            if step is None:
                return results
            results.append(self._step(key, c, table, json.loads(step)))

    def _pass_gaps(self, key, c: dict, table: _Table, waiting: _Waiting, now: int) -> list[Row]:
        """Go on beyond missing steps whose time is over; a timer for the next one that may still come."""
        results = []
        while first := waiting.first(c["k"]):
            k, step = first
            until = json.loads(step)["at_ms"] + self.wait_ms
            if until > now:
                self.handle.registerTimer(until)
                break
            c["gap"] = k - c["k"] - 1
            c["missing"] += c["gap"]
            c["k"] = k - 1
            results += self._go_on(key, c, table, waiting, {})
        return results

    def _step(self, key, c: dict, table: _Table, step: dict) -> Row:
        before = {"kind": c["kind"], "fails": c.get("fails"), "read_files": c.get("read_files", 0)}
        row = _advance(c, table, step)
        if self.dynamics:
            row |= SD.advance(c, table, step, row, before, self.similarity)
        c["shown"] = (c["shown"] + [step["shown_cmd"]])[-5:]
        values = [*row.values(), c.pop("gap", 0), c["missing"]]
        return Row(trajectory_id=key[0], numbers=",".join(["" if v is None else repr(v) for v in values]),
                   recent_commands=list(c["shown"]))


def _bump(c: dict, name: str, by: int = 1) -> int:
    c[name] = c.get(name, 0) + by
    return c[name]


def _top(c: dict, name: str, value: int) -> None:
    c[name] = max(c.get(name, 0), value)


def _is_test_path(path: str) -> bool:
    low = path.lower()
    base = low.rsplit("/", 1)[-1]
    return "/test" in low or low.startswith("test") or base.startswith("test_") or base.endswith("_test.py")


def _advance(c: dict, table: _Table, s: dict) -> dict:
    """Move the counters one step on and return the features of the new prefix."""
    kind, k, cmd = s["kind"], c["k"] + 1, s["cmd"]
    c["k"] = k
    first_edit = kind == "edit" and "first_edit" not in c
    if first_edit:
        c["first_edit"] = k
        c["no_read"], c["no_search"] = int(not c.get("n_read")), int(not c.get("n_search"))
    if "first_edit" not in c and kind in ("read", "search"):
        _bump(c, f"early_{kind}")
    _bump(c, f"n_{kind}")
    _bump(c, "actions", s["has_action"])
    _bump(c, "tokens", (s["thought_len"] + s["action_len"]) // 4)
    _bump(c, "obs", s["obs_len"])
    for path in s["files"]:
        if table.add("seen:" + path) == 1:
            _bump(c, "test_files" if _is_test_path(path) else "src_files")
        if kind == "read":
            n = table.add("read:" + path)
            _top(c, "max_reads", n)
            if n == 1:
                _bump(c, "read_files")
                _bump(c, "unread_edits", -1 if table.get("edit:" + path) else 0)
        elif kind == "edit":
            n = table.add("edit:" + path)
            _top(c, "max_edits", n)
            if n == 1:
                _bump(c, "edit_files")
                _bump(c, "unread_edits", 0 if table.get("read:" + path) else 1)
            if table.add("dir:" + (path.rsplit("/", 1)[0] if "/" in path else "")) == 1:
                _bump(c, "edit_dirs")
    if s["is_test"]:
        _bump(c, "tests")
        _bump(c, "test_repeats", int(table.add("test:" + cmd) > 1))
        c["code"] = s["test_code"]
        c["passes"] = s["passes"] if s["passes"] is not None else c.get("passes", -1)
        if s["fails"] is not None:
            c["delta"] = s["fails"] - c["fails"] if "fails" in c else 0
            c["fails"] = s["fails"]
    _bump(c, "tracebacks", s["traceback"])
    _bump(c, "assertions", s["assertion"])
    if cmd:
        _top(c, "max_cmd", table.add("cmd:" + cmd))
    c["recent"] = (c["recent"] + [cmd])[-5:]
    _bump(c, "edit_test", int(c["kind"] == "edit" and kind == "test"))
    c["streak"] = c["streak"] + 1 if c["kind"] == kind else 1
    c["kind"] = kind
    g = c.get
    delta = g("delta", 0)

    def repeated(n: int) -> int:
        filled = [x for x in c["recent"][-n:] if x]
        return int(len(filled) > len(set(filled)))

    values = [
        k, g("actions", 0), g("tokens", 0), g("obs", 0), g("obs", 0) / k,
        *[g(f"n_{t}", 0) for t in P.ACTION_TYPES],
        g("n_edit", 0) / max(1, g("n_read", 0)), g("n_test", 0) / max(1, g("n_edit", 0)),
        g("n_search", 0) / max(1, g("n_edit", 0)),
        g("first_edit", -1), g("early_read", 0), g("early_search", 0), g("no_read", 0), g("no_search", 0),
        g("test_files", 0) + g("src_files", 0), g("read_files", 0), g("edit_files", 0), g("edit_dirs", 0),
        g("test_files", 0), g("src_files", 0), g("unread_edits", 0), g("max_edits", 0),
        g("tests", 0), g("code", -1), g("fails", -1), g("passes", -1), delta, int(delta < 0), int(delta > 0),
        g("test_repeats", 0), g("tracebacks", 0), g("assertions", 0),
        repeated(3), repeated(5), g("max_cmd", 0), c["streak"], g("edit_test", 0), g("max_reads", 0)]
    return dict(zip(BASE_FEATURES, values))


def feature_stream(steps: DataFrame, ttl_ms: int | None = None, dynamics: bool = False, similarity: str = "blocks",
                   wait_seconds: int | None = None, delay: str = "1 hour", time: str = "ts") -> DataFrame:
    """Features of every step of a step stream: the base ones and, if wanted, the dynamics.

    ``wait_seconds`` lets a run go on without a step that has not come when the watermark (``delay`` behind
    the latest ``time``) is so far beyond the first step after it; ``gap`` then counts the steps left out.
    Without it every step waits for all before it.
    """
    timed = wait_seconds is not None
    if timed:
        steps = steps.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    source = with_defaults(steps)
    signals = step_signals(source, errors=dynamics, keep=[time] if timed else [])
    processor = StepFeatures(ttl_ms, dynamics, similarity, 1000 * wait_seconds if timed else None)
    if timed:
        signals = signals.withColumn("at_ms", F.unix_millis(time))
    mode = "EventTime" if timed else "None" if ttl_ms is None else "ProcessingTime"
    body = F.to_json(F.struct(*processor.signals), {"ignoreNullFields": "false"})
    packed = signals.select("trajectory_id", "k", body.alias("body"), *([time] if timed else [])).groupBy(
        "trajectory_id").transformWithState(
        statefulProcessor=processor, outputStructType=PACKED, outputMode="Append", timeMode=mode)
    names = [n.split()[0] for n in output_schema(dynamics).split(", ")]
    numbers = F.from_csv("numbers", numbers_schema(dynamics))
    return packed.select("trajectory_id", "recent_commands", numbers.alias("n")).select(
        "trajectory_id", "n.*", "recent_commands").select(*names)
