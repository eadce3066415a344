import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailcast.llm import multi_index

SCHEMA = "vec_id long, embedding array<float>, label int, row string, score double, cell int, d int"


def brute(rows, k=5, m=3):
    use = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for a, (i, label, q) in enumerate(use):
        if i % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, w)), j, other) for b, (j, other, w) in enumerate(use)
                        if b != a and len(w) == len(q))
        for s, j, _ in [x for x in scored if x[2] == label][:k]:
            fits = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:m]
            out += [(i, j, r, n, -s, -t) for r, (t, n, _) in enumerate(fits, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 0.5, 1, 2) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("settings", [{}, {"cell_rows": 20, "first_rows": 4}, {"cell_rows": 3, "first_rows": 1}])
def test_windows_equal_brute_force(spark, settings, monkeypatch):
    monkeypatch.setattr(multi_index, "TILE", 16)
    monkeypatch.setattr(multi_index, "BLOCK", 3)
    rng = random.Random(4)
    centers = [[rng.gauss(0, 0.3) for _ in range(9)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in centers[i % 6]], i % 4) for i in range(420)]
    rows += [(1000 + i, rows[50][1], i % 2) for i in range(30)]  # copies: ties of every score
    rows += [(2000 + 50 * i, [rng.gauss(0, 1) for _ in range(d)], i % 2) for i, d in enumerate([2, 2, 2, 1, 1, 0, 0, 4])]
    rows += [(50, None, 1), (100, [0.1, None], 1), (150, [float("nan")] * 9, 1), (200, [0.2] * 9, None), (None, [0.2] * 9, 1),
             (250, [float("inf")] * 9, 2), (300, [0.0] * 9, 2), (300, [0.0] * 9, 1), (350, [1e30] * 9, 2)]
    got = sorted(tuple(r) for r in multi_index.mine(frame(spark, rows), F.col("vec_id") % 50 == 0, **settings).collect())
    assert got == brute([r for r in rows if r[0] != 350 or r[1][0] < 1e29])
    assert got


def test_products_beyond_doubles_are_exact():
    a = np.array([[2**30 - 1, 3]], np.int32)
    assert multi_index._scores(a, a, 2.0**60)[0, 0] == (2**30 - 1) ** 2 + 9


def test_falling_cells_cover_every_pair_once():
    rng = np.random.default_rng(0)
    first, second = rng.normal(size=7), rng.normal(size=5)
    seen = list(multi_index.falling_cells(first, second))
    assert len({(u, v) for u, v, _ in seen}) == 35 and [b for _, _, b in seen] == sorted((b for _, _, b in seen), reverse=True)


def test_bounded_visits_leave_cells_out(spark):
    """On clustered vectors the certified stop leaves most cells unvisited."""
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(8, 16)) * 400
    x = (centers[np.arange(4000) % 8] + rng.normal(size=(4000, 16)) * 5).astype(np.int32)
    books = multi_index.Codebooks({16: (multi_index._fit_half(x[:, :8], 8, 3), multi_index._fit_half(x[:, 8:], 8, 4))})
    (u, r1), (v, r2) = books.assign(x)
    radii = tuple(np.array([r[c == i].max(initial=0.0) for i in range(8)]) for c, r in ((u, r1), (v, r2)))
    first, second = books.bounds(x[:1], radii)
    need = np.sort(x @ x[0])[-6]
    reached = [(a, b) for a, b, bound in multi_index.falling_cells(first[0], second[0]) if bound >= need]
    assert 1 <= len(reached) < 16
    got = {(a, b) for a, b in zip(u[(x @ x[0]) >= need], v[(x @ x[0]) >= need])}
    assert got <= set(reached)


def test_empty_table(spark):
    assert multi_index.mine(frame(spark, [(1, [0.1], 1)]).where("false"), F.col("vec_id") % 50 == 0).count() == 0
