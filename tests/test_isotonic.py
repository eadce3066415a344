"""Isotonic calibration merged from score ranges against a plain pool-adjacent-violators fit."""

import random

import pytest
from pyspark.sql import functions as F

from trailcast.operators import isotonic
from trailcast.operators.calibration import fit_calibrator
from trailcast.operators.metrics import histogram


def plain_fit(rows):
    """score -> fitted value, pooling row by row in floats."""
    by_score = {}
    for s, y in rows:
        by_score.setdefault(s, []).append(y)
    blocks = []
    for s in sorted(by_score):
        blocks.append([[s], by_score[s]])
        while len(blocks) > 1 and sum(blocks[-2][1]) / len(blocks[-2][1]) >= sum(blocks[-1][1]) / len(blocks[-1][1]) - 1e-15:
            scores, ys = blocks.pop()
            blocks[-1][0] += scores
            blocks[-1][1] += ys
    return {s: sum(ys) / len(ys) for scores, ys in blocks for s in scores}


def noisy(n, distinct, seed):
    rng = random.Random(seed)
    return [((s := rng.randint(0, distinct) / distinct), int(rng.random() < 0.2 + 0.6 * s)) for _ in range(n)]


@pytest.mark.parametrize("rows", [noisy(3000, 700, 1), noisy(500, 5, 2), noisy(400, 100_000, 3), [(0.5, 1), (0.5, 0), (0.5, 1)],
                                  [(0.1, 1), (0.9, 0)], [(0.1, 0), (0.2, 0), (0.8, 1)]])
@pytest.mark.parametrize("parts", [1, 40])
def test_merged_ranges_equal_the_plain_fit(spark, rows, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(rows, "risk double, y_fail int")
        want = plain_fit(rows)
        got = fit_calibrator(df).apply(df.select("risk").distinct()).collect()
        assert all(r["calibrated"] == pytest.approx(want[r["risk"]], abs=1e-12) for r in got) and len(got) == len(want)
        found = isotonic.blocks(histogram(df, "risk", "y_fail"))
        assert found.agg(F.sum("n")).first()[0] == len(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_class_is_the_identity(spark):
    df = spark.createDataFrame([(0.3, 1), (0.7, 1)], "risk double, y_fail int")
    assert fit_calibrator(df).method == "identity"
