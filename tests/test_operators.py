"""Operators on small tables with known answers."""

import pytest
from pyspark.sql import functions as F

from trailcast.functions import text as T
from trailcast.operators import alerts as AL
from trailcast.operators import interventions as IV
from trailcast.operators import judge as J
from trailcast.operators import metrics as M
from trailcast.operators import splits as SP
from trailcast.operators.calibration import fit_calibrator
from trailcast.operators.ordering import number_rows, quantile_bucket, real_bucket


@pytest.fixture(scope="module")
def draws(spark):
    """Scores that are calibrated by construction: the label is drawn with the score as chance."""
    u = (T.hash_number(F.lit("p"), F.col("id")) % 1000) / 1000.0
    v = (T.hash_number(F.lit("y"), F.col("id")) % 1000) / 1000.0
    return spark.range(4000).select(
        F.col("id").cast("string").alias("prefix_id"), (F.col("id") % 97).cast("string").alias("instance_id"),
        u.alias("risk"), (v < u).cast("bigint").alias("y_fail"))


def test_auc_against_all_pairs_for_any_bucket(spark, draws):
    small = draws.limit(300).withColumn("risk", F.round("risk", 2)).cache()
    rows = [(r.risk, r.y_fail) for r in small.collect()]
    pairs = [(a > b) + 0.5 * (a == b) for a, y in rows if y for b, z in rows if not z]
    expected = sum(pairs) / len(pairs)
    h = M.histogram(small)
    for bucket in (None, quantile_bucket(h, "score", 16), real_bucket(F.col("score"), 4)):
        assert M.auc_of_histogram(h, bucket=bucket).first().auc == pytest.approx(expected)


def test_single_class_has_no_auc(spark, draws):
    assert M.roc_auc(draws.where("y_fail = 1")).first().auc is None


def test_calibration_error(draws):
    assert M.calibration_error(draws).first().ece < 0.05
    off = draws.withColumn("risk", F.least(F.lit(1.0), F.col("risk") + 0.3))
    assert M.calibration_error(off).first().ece > 0.1
    better = fit_calibrator(off, "isotonic").apply(off)
    assert M.calibration_error(better, "calibrated").first().ece < 0.02


def test_first_alert(spark):
    rows = [("a", 4, 1, s, r) for s, r in [(1, 0.1), (2, 0.3), (3, 0.7), (4, 0.9)]] + [("b", 4, 0, 4, 0.2)]
    risk = spark.createDataFrame(rows, "trajectory_id string, n_total_steps bigint, y_fail bigint, prefix_step bigint, risk double")
    got = {r.trajectory_id: (r.first_alarm_step, r.lead_steps) for r in AL.first_alerts(risk, 0.6).collect()}
    assert got == {"a": (3, 1), "b": (None, None)}
    assert AL.false_alarm_threshold(risk, 0.1).first().threshold == 0.3


def test_replay_against_a_loop(spark):
    rows = [("r%d" % i, 1, 80, s, ((s * (i + 3)) % 11) / 10.0) for i in range(6) for s in range(1, 81)]
    risk = spark.createDataFrame(rows, "trajectory_id string, y_fail bigint, n_total_steps bigint, prefix_step bigint, risk double")
    for cooldown, budget in ((1, 3), (4, 2), (7, 4)):
        expected = {}
        for run, _, _, s, r in rows:
            done = expected.setdefault(run, [])
            if s >= 5 and abs(r - 0.5) >= 0.1 and r >= 0.6 and len(done) < budget and (not done or s - done[-1] >= cooldown):
                done.append(s)
        got = {r.trajectory_id: list(r.alarms) for r in IV.replay(risk, 0.6, 5, 0.1, cooldown, budget).collect()}
        assert got == expected


def test_most_repeated_command(spark):
    rows = spark.createDataFrame([(["a", "b", "b", "a", "c"],), (["a", "b"],), ([],)], "c array<string>")
    got = [r.b and (r.b["count"], r.b.command) for r in rows.select(IV.most_repeated(F.col("c")).alias("b")).collect()]
    assert got == [(2, "a"), None, None]


def test_replies(spark):
    texts = ['{"risk_score": 0.4}', 'x ```json\n{"risk_score": 1.0, "intervention_type": "dance"}\n```', '{"risk_score": 1.4}', "none"]
    got = J.read_replies(spark.createDataFrame([(t,) for t in texts], "reply string")).select("judge_risk", "valid_json", "intervention_type").collect()
    assert [tuple(r) for r in got] == [(0.4, 1, "none"), (1.0, 1, "none"), (0.5, 0, "none"), (0.5, 0, "none")]


def test_splits_are_disjoint_and_complete(draws):
    rows = SP.split(draws)
    assert rows.count() == draws.count()
    assert SP.overlap(rows).first().n_shared == 0
    with pytest.raises(ValueError):
        SP.check_disjoint(rows.withColumn("fold", F.col("prefix_id")))


def test_row_numbers_are_a_permutation(spark):
    rows = spark.range(1000).withColumn("v", (F.col("id") * 7919) % 101 / 10.0)
    numbered = number_rows(rows, [F.col("v"), F.col("id")], real_bucket(F.col("v"))).orderBy("v", "id")
    assert [r.row_no for r in numbered.collect()] == list(range(1, 1001))
