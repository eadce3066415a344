"""Streams against the batch operators and plain rules."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from step_tables import make_steps
from trailcast.operators import features as FT
from trailcast.streaming import alert_policy as AP
from trailcast.streaming import step_dynamics as SD
from trailcast.streaming import step_features as SF

START = datetime(2024, 1, 1)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_bit_distance_equals_the_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcé ") for _ in range(rng.randint(0, 40))) for _ in range(2))
        assert SD.edit_distance(a, b) == plain_distance(a, b)


def mixed_steps(spark, n=45):
    rng = random.Random(7)
    acts = ["cat src/a.py", "cat src/b.py", "rg foo", "sed -i s/a/b/ src/a.py", "python -m pytest tests/test_a.py", "ls -la", "", "git diff"]
    obs = ["", "line 1", "2 failed, 3 passed", "1 failed, 4 passed", "Traceback (most recent call last)\nValueError: x", "5 passed",
           "ModuleNotFoundError: No module named q\nTraceback (most recent call last)"]
    return make_steps(spark, {f"r{k}": [(rng.choice(acts), rng.choice(obs)) for _ in range(n - 9 * k)] for k in range(3)})


def run(spark, parts, folder, **options):
    schema = ", ".join(f"{n} {t}" for n, t in parts[0].dtypes)
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = AP.run_to_end(SF.feature_stream(AP.open_steps(spark, f"{folder}/in", schema), **options), f"{folder}/out")
    return out


@pytest.mark.parametrize("similarity", ["edit", "blocks"])
def test_streamed_dynamics_equal_batch(spark, tmp_path, similarity):
    steps = mixed_steps(spark)
    odd, even = steps.where("step_index % 3 = 1"), steps.where("step_index % 3 <> 1")
    out = run(spark, [even.union(even), odd], str(tmp_path), dynamics=True, similarity=similarity)
    runs = steps.groupBy("trajectory_id").agg(F.count("*").alias("n_total_steps"), F.lit(1).alias("y_fail"))
    batch = FT.prefix_table(steps, runs, schedule="dense", features="dynamics", similarity=similarity)
    names = [n for n in FT.BASE_FEATURES if n != "prefix_step"] + SD.DOUBLES + SD.LONGS
    assert {f"f__{n}" for n in names} | {"f__prefix_step"} == {c for c in batch.columns if c.startswith("f__")}
    got = {(r["trajectory_id"], r["prefix_step"]): r for r in out.collect()}
    want = {(r["trajectory_id"], r["prefix_step"]): r for r in batch.collect()}
    assert set(got) == set(want)
    for key in want:
        for n in names:
            assert got[key][n] == pytest.approx(want[key]["f__" + n], abs=1e-9), (key, n)


def timed(steps, minutes=1):
    return steps.withColumn("ts", F.lit(START) + F.make_interval(mins=(F.col("step_index") * minutes).cast("int")))


def test_a_missing_step_is_passed_when_its_time_is_over(spark, tmp_path):
    steps = timed(mixed_steps(spark, 30))
    holed = steps.where("not (trajectory_id = 'r0' and step_index in (0, 7, 8, 20))")
    first, later = holed.where("step_index < 15"), holed.where("step_index >= 15")
    out = run(spark, [first, later], str(tmp_path), wait_seconds=180, delay="0 seconds")
    rows = {(r["trajectory_id"], r["prefix_step"]): r for r in out.collect()}
    mine = [k for t, k in sorted(rows) if t == "r0"]
    assert mine == [k for k in range(1, 31) if k - 1 not in (0, 7, 8, 20)]
    assert {k: rows["r0", k]["gap"] for k in mine if rows["r0", k]["gap"]} == {2: 1, 10: 2, 22: 1}
    assert rows["r0", 30]["n_missing"] == 4 and rows["r1", 21]["n_missing"] == 0


def test_a_gap_near_the_end_still_waits_and_a_late_step_fills_it(spark, tmp_path):
    steps = timed(mixed_steps(spark, 30)).where("trajectory_id = 'r0'")
    most, late = steps.where("step_index not in (27)"), steps.where("step_index = 27")
    options = {"wait_seconds": 3600, "delay": "2 hours"}
    out = run(spark, [most], str(tmp_path / "a"), **options)
    assert out.agg(F.max("prefix_step")).first()[0] == 27
    out = run(spark, [most, late], str(tmp_path / "b"), **options)
    assert out.count() == 30 and out.agg(F.sum("gap")).first()[0] == 0


def test_stream_with_the_fitted_monitor_equals_batch(spark, sf_dir, tmp_path, monkeypatch):
    from trailcast.operators import interventions as IV
    from trailcast.operators import models as MD
    from trailcast.operators import prefixes as PX
    from trailcast.plans import streams, training

    monkeypatch.setattr(MD, "BOOSTED", MD.BO.Settings(rounds=20))
    parts = training.fitted_monitor(spark, sf_dir)
    monkeypatch.setattr(streams, "fitted_monitor", lambda *_: parts)
    rows, model, calibrator = parts
    inner = rows.where("fold = 'test'").where(PX.on_schedule(F.col("prefix_step"), F.col("prefix_step") + 1))
    want = IV.verdicts(calibrator.apply(model.score(inner)), threshold=0.6, min_step=5, conf_floor=0.05)
    want = {(r["trajectory_id"], r["prefix_step"]): r for r in want.collect()}
    got = {(r["trajectory_id"], r["prefix_step"]): r for r in streams.stream_monitor_verdicts(spark, sf_dir).collect()}
    assert set(got) == set(want) and any(r["alarm"] for r in want.values())
    for key, w in want.items():
        g = got[key]
        assert g["calibrated"] == pytest.approx(w["calibrated_risk"])
        assert (g["alarm"], g["abstain"], g["would_alarm"]) == (w["alarm"], w["abstain"], w["would_alarm"]), key
        if not g["abstain"]:
            assert (g["kind"], g["message"]) == (w["recommended_intervention"], w["message"])


def test_a_new_model_serves_from_the_next_batch_on(spark, tmp_path):
    from trailcast.operators.models import RiskModel
    from trailcast.streaming import scoring as SC

    steps = mixed_steps(spark, 20)
    schema = ", ".join(f"{n} {t}" for n, t in steps.dtypes)
    folder, models = str(tmp_path), str(tmp_path / "models")
    for version, (risk, part) in enumerate([(0.1, steps.where("step_index < 10")), (0.9, steps.where("step_index >= 10"))], 1):
        SC.publish(spark, models, version, RiskModel("baseline_majority", constant=risk))
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        features = SF.feature_stream(AP.open_steps(spark, f"{folder}/in", schema))
        out = SC.verdicts_to_end(spark, features, models, folder, AP.AlertPolicy(0.6))
    seen = {(r["prefix_step"] > 10, r["model_version"], r["calibrated"]) for r in out.collect()}
    assert seen == {(False, 1, 0.1), (True, 2, 0.9)}
    assert out.where("would_alarm = 1 and prefix_step <= 10").count() == 0 and out.where("would_alarm = 1").count() > 0


def test_scoring_names_the_state_store_itself(spark, tmp_path):
    from trailcast.operators.models import RiskModel
    from trailcast.streaming import scoring as SC

    fresh = spark.newSession()
    fresh.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")  # the default one
    steps = mixed_steps(fresh, 20)
    steps.coalesce(1).write.parquet(f"{tmp_path}/in")
    SC.publish(fresh, f"{tmp_path}/models", 1, RiskModel("baseline_majority", constant=0.9))
    features = SF.feature_stream(AP.open_steps(fresh, f"{tmp_path}/in", ", ".join(f"{n} {t}" for n, t in steps.dtypes)))
    out = SC.verdicts_to_end(fresh, features, f"{tmp_path}/models", str(tmp_path), AP.AlertPolicy(0.6))
    assert out.count() == steps.count()
