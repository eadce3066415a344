"""Histogram boosting against brute-force split search, and both ways of growing against each other."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailcast.operators import boosting as B
from trailcast.operators import metrics as M

COLUMNS = ["a", "b", "c"]


def table(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.randint(0, 30), rng.randint(0, 5), rng.randint(0, 400) / 7
        rows.append((i, float(a), float(b), c, int(rng.random() < 1 / (1 + math.exp(-(a - 15) / 5 - (b - 2) * (c > 30))))))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y_fail int").repartition(3), rows


def brute_tree(rows, s):
    """One tree on (features, g, h): best leaf first, every cut of every feature tried."""
    def best(part):
        found = None
        total_g, total_h = sum(r[1] for r in part), sum(r[2] for r in part)
        for f in range(3):
            values = sorted({r[0][f] for r in part})
            for lo, hi in zip(values[:-1], values[1:]):
                left = [r for r in part if r[0][f] <= lo]
                if len(left) < s.min_rows or len(part) - len(left) < s.min_rows:
                    continue
                g, h = sum(r[1] for r in left), sum(r[2] for r in left)
                gain = B.gains(g, h, total_g, total_h, s.l2)
                if gain > 1e-9 and (found is None or gain > found[0] + 1e-9):
                    found = (gain, f, lo)
        return found

    leaves = [(rows, best(rows))]
    while len(leaves) < s.leaves and any(x[1] for x in leaves):
        k = max((i for i in range(len(leaves)) if leaves[i][1]), key=lambda i: leaves[i][1][0])
        part, (_, f, cut) = leaves.pop(k)
        for side in ([r for r in part if r[0][f] <= cut], [r for r in part if r[0][f] > cut]):
            leaves.append((side, best(side)))
    return {id(r): -s.rate * sum(x[1] for x in part) / (sum(x[2] for x in part) + s.l2) for part, _ in leaves for r in part}


@pytest.mark.parametrize("in_task", [True, False])
def test_one_tree_equals_brute_force(spark, monkeypatch, in_task):
    if not in_task:
        monkeypatch.setattr(B, "TASK_ROWS", 0)
    df, rows = table(spark)
    s = B.Settings(rounds=1, leaves=8)
    fitted = B.fit_many(df, COLUMNS, s)
    rate = sum(r[4] for r in rows) / len(rows)
    parts = [(r[1:4], rate - r[4], rate * (1 - rate)) for r in rows]
    want = brute_tree(parts, s)
    got = fitted.trees["model"].margins(np.array([r[1:4] for r in rows]))
    start = math.log(rate / (1 - rate))
    assert np.allclose(got - start, [want[id(p)] for p in parts], atol=1e-5)
    assert len({round(x, 9) for x in got}) == 8


def test_both_ways_give_the_same_trees(spark, monkeypatch):
    df, _ = table(spark, 700)
    many = df.withColumn("models", F.array(F.lit("all"), F.concat(F.lit("part"), (F.col("id") % 3).cast("string"))))
    s = B.Settings(rounds=12, leaves=6, early_rows=300, patience=2)
    monkeypatch.setattr(B, "SEGMENT", 5)
    only = {"part1": ["a", "b"]}
    in_task = B.fit_many(many, COLUMNS, s, "models", only, weight="a")
    monkeypatch.setattr(B, "TASK_ROWS", 200)
    assert B.fit_many(many, COLUMNS, s, "models", only, weight="a") == in_task
    assert set(in_task.trees) == {"all", "part0", "part1", "part2"}
    assert 2 not in in_task.trees["part1"].feature and 2 in in_task.trees["all"].feature


def test_scores_by_model_and_storage(spark):
    df, _ = table(spark, 500)
    fitted = B.fit_many(df.withColumn("models", F.array(F.lit("x"), F.lit("y"))), COLUMNS, B.Settings(rounds=30), "models")
    again = B.Boosters.from_json(fitted.to_json())
    named = df.withColumn("name", F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "y"))
    got = named.select("id", again.risk(F.col("name")).alias("risk"), "y_fail").collect()
    assert all((r["risk"] is None) == (r["id"] % 3 == 2) for r in got)
    assert M.roc_auc(df.withColumn("risk", again.risk(F.lit("x")))).first().auc > 0.85


def test_degenerate_tables(spark):
    df, _ = table(spark, 60)
    one_class = B.fit_many(df.withColumn("y_fail", F.lit(1)), COLUMNS, B.Settings(rounds=2))
    assert df.select(one_class.risk().alias("r")).where("r < 0.999").count() == 0
    flat = B.fit_many(df.select(F.lit(1.0).alias("a"), "y_fail"), ["a"], B.Settings(rounds=2))
    rate = df.agg(F.avg("y_fail")).first()[0]
    assert df.withColumn("a", F.lit(3.0)).select(flat.risk().alias("r")).where(F.abs(F.col("r") - rate) > 1e-6).count() == 0
    assert B.fit_many(df.where("false"), COLUMNS).trees == {}


def test_many_values_are_cut_at_quantiles(spark):
    df = spark.range(5000).select((F.col("id") * F.col("id")).cast("double").alias("a"), F.lit(2.0).alias("b"))
    edges, flat = B.bin_edges(df, ["a", "b"])
    assert len(flat) == 0 and 200 <= len(edges) <= 255 and (np.diff(edges) > 0).all()
    sizes = np.bincount(np.searchsorted(edges, np.arange(5000.0) ** 2), minlength=len(edges) + 1)
    assert sizes.max() <= 45


def test_large_models_grow_in_jobs_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(B, "TASK_ROWS", 0)
    monkeypatch.setattr(B, "SEGMENT", 2)
    df, _ = table(spark, 400)
    grow, seen = B._grow_together, {}
    tracker = spark.sparkContext.statusTracker()

    def watched(*args):
        spark.sparkContext.setJobGroup("grow", "trees of a large model")
        grow(*args)
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("grow")]
        seen["stages"], seen["jobs"] = sum(len(j.stageIds) for j in jobs), len(jobs)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    monkeypatch.setattr(B, "_grow_together", watched)
    fitted = B.fit_many(df, COLUMNS, B.Settings(rounds=5, leaves=6))
    assert len(fitted.trees["model"].roots) == 5
    assert seen["stages"] <= 2 * seen["jobs"]  # the rows are dealt once; a grouped sum would add stages to every step


def test_tables_of_many_cells_leave_the_task(spark, monkeypatch):
    df, _ = table(spark, 300)
    s = B.Settings(rounds=3, leaves=4)
    in_task, grow, seen = B.fit_many(df, COLUMNS, s), B._grow_together, []
    monkeypatch.setattr(B, "_grow_together", lambda *args: seen.append(1) or grow(*args))
    assert 100_000 < B.TASK_ROWS <= 500_000 and not seen
    monkeypatch.setattr(B, "TASK_CELLS", 300 * len(COLUMNS) - 1)
    assert B.fit_many(df, COLUMNS, s) == in_task and seen


def test_values_of_all_tasks_make_the_bins(spark):
    df = spark.range(0, 600, 1, 5).select(F.floor(F.col("id") / 2).cast("double").alias("many"),
                                          (F.col("id") % 250 - 3).cast("double").alias("few"))
    many, few = B.bin_edges(df, ["many", "few"])
    assert few.tolist() == [x - 2.5 for x in range(249)] and 200 <= len(many) <= 255
