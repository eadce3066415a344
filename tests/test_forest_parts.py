"""A forest that is too large for one fit is grown in stored parts."""

import threading

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from trailcast.operators import models as MD
from trailcast.operators import report as RP
from trailcast.session import cut_lineage


def test_a_large_forest_is_grown_in_parts_with_all_its_trees(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(MD, "FOREST_ROWS", 700)
    rows = cut_lineage(spark.range(300).select(
        F.col("id").cast("string").alias("prefix_id"), (F.col("id") % 17).alias("f__a"), (F.col("id") % 23).alias("f__b"),
        ((F.col("id") % 17 + F.col("id") % 5) > 9).cast("bigint").alias("y_fail")))
    model = MD.fit("random_forest", rows, trees=7)
    assert model.pipeline is None and [n for _, n in model.parts] == [2, 2, 3]
    found = [PipelineModel.load(p).stages[-1].getNumTrees for p, _ in model.parts]
    assert found == [2, 2, 3]

    def single(path):
        scored = PipelineModel.load(path).transform(MD._inputs(rows, model.columns))
        return {r.prefix_id: r.p for r in scored.select("prefix_id", vector_to_array("probability")[1].alias("p")).collect()}

    own = [single(p) for p, _ in model.parts]
    scored = model.score(rows)
    assert scored.columns == [*rows.columns, "risk"]
    got = {r.prefix_id: r.risk for r in scored.collect()}
    assert len(got) == 300 and len(set(got.values())) > 2
    assert all(abs(v - (2 * own[0][k] + 2 * own[1][k] + 3 * own[2][k]) / 7) < 1e-12 for k, v in got.items())
    model.save(str(tmp_path / "m"))
    again = {r.prefix_id: r.risk for r in MD.RiskModel.load(str(tmp_path / "m")).score(rows).collect()}
    assert again == got


def _rows(spark, n):
    return spark.range(n).select(
        *[F.col("id").cast("string").alias(c) for c in ("prefix_id", "trajectory_id", "instance_id")],
        F.lit(1).alias("prefix_step"), F.lit(1).alias("n_total_steps"), (F.col("id") % 17).alias("f__a"),
        (F.col("id") % 17 > 9).cast("bigint").alias("y_fail"))


def test_parts_are_grown_side_by_side_in_few_tasks(spark, monkeypatch):
    monkeypatch.setattr(MD, "FOREST_ROWS", 700)
    fit, met, tasks = MD.Pipeline.fit, threading.Barrier(2, timeout=60), []

    def together(self, rows):
        met.wait()  # breaks if the fits come one after another
        tasks.append(rows.rdd.getNumPartitions())
        return fit(self, rows)

    monkeypatch.setattr(MD.Pipeline, "fit", together)
    model = MD.fit("random_forest", cut_lineage(_rows(spark, 300).repartition(4)), trees=4)
    assert [n for _, n in model.parts] == [2, 2] and tasks == [1, 1]


def test_both_folds_are_scored_in_one_pass(spark, monkeypatch):
    calls, score = [], MD.RiskModel.score
    monkeypatch.setattr(MD.RiskModel, "score", lambda self, *args: calls.append(self.name) or score(self, *args))
    rows = _rows(spark, 40)
    models = MD.fit_all(["baseline_majority", "logistic_regression"], cut_lineage(rows))
    val, test = RP.score_folds(models, rows.where("prefix_id < '2'"), rows)
    assert sorted(calls) == ["baseline_majority", "logistic_regression"]
    assert val.columns == ["model", *RP.SLIM, "risk"] == test.columns
    assert val.count() == 2 * rows.where("prefix_id < '2'").count() and test.count() == 2 * rows.count()
