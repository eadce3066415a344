"""State of the stream processor, on plain dictionaries: few values lie together, many by key."""

import json
import random
from types import SimpleNamespace

import pytest

from trailcast.streaming import step_dynamics as SD
from trailcast.streaming import step_features as SF


class Value:
    body = None

    def exists(self):
        return self.body is not None

    def get(self):
        return self.body

    def update(self, body):
        self.body = body


class Map(dict):
    calls = 0

    def getValue(self, key):
        self.calls += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def containsKey(self, key):
        self.calls += 1
        return key in self

    def removeKey(self, key):
        self.calls += 1
        del self[key]


class Handle:
    def __init__(self):
        self.maps, self.timers = [], []

    def getValueState(self, *_):
        return Value()

    def getMapState(self, *_):
        self.maps.append(Map())
        return self.maps[-1]

    def registerTimer(self, at):
        self.timers.append(at)


def steps(n=120):
    rng = random.Random(3)
    out = []
    for k in range(1, n + 1):
        path, kind = f"src/f{rng.randrange(30)}.py", rng.choice(["read", "edit", "test", "search"])
        out.append({"k": k, "kind": kind, "files": [path], "cmd": f"run {path}", "shown_cmd": "run", "is_test": kind == "test",
                    "has_action": 1, "thought_len": 4, "action_len": 9, "obs_len": 7, "passes": 1, "fails": rng.randrange(3),
                    "test_code": 1, "traceback": 0, "assertion": 0, "is_err": int(kind == "test"), "obs_key": f"o{k % 9}",
                    "err_line": None, "at_ms": 1000 * k, **{f"err_{n}": k % 2 for n in SD.P.ERROR_CATEGORIES}})
    return out


def played(batches):
    handle, clock = Handle(), SimpleNamespace(getCurrentWatermarkInMs=lambda: clock.now)
    processor = SF.StepFeatures(dynamics=True, similarity="edit", wait_ms=5000)
    processor.init(handle)
    rows = []
    for now, batch in batches:
        clock.now = now
        rows += processor.handleInputRows(("r",), [SimpleNamespace(k=s["k"], body=json.dumps(s)) for s in batch], clock)
    clock.now = 10**9
    rows += processor.handleExpiredTimer(("r",), clock, SimpleNamespace(getExpiryTimeInMs=lambda: 0))
    return [tuple(r) for r in rows], handle


def holed_batches():
    kept = [s for s in steps() if s["k"] not in (3, 40, 41, 90)]
    random.Random(4).shuffle(kept)
    return [(0, kept[:70] + kept[:9]), (30_000, kept[70:100]), (60_000, kept[100:])]


def test_a_short_run_needs_no_keyed_state():
    rows, handle = played(holed_batches())
    assert len(rows) > 100 and [m.calls for m in handle.maps] == [0, 0]


@pytest.mark.parametrize("few, waiting", [(5, 250), (1000, 3), (40, 20)])
def test_results_are_the_same_beyond_few_values(monkeypatch, few, waiting):
    want, _ = played(holed_batches())
    monkeypatch.setattr(SF, "FEW", few)
    monkeypatch.setattr(SF, "FEW_WAITING", waiting)
    got, handle = played(holed_batches())
    assert got == want and sum(m.calls for m in handle.maps) > 0
