"""Models by their invariants on a table with a planted signal."""

import random
from collections import Counter

from pyspark.sql import functions as F

from trailcast.functions import text as T
from trailcast.operators import metrics as M
from trailcast.operators import models as MD
from trailcast.operators.calibration import fit_calibrator
from trailcast.operators.labels import shuffled_labels
from trailcast.operators.splits import greedy_shares
from trailcast.session import cut_lineage


def planted(spark, n=1200):
    def noise(name):
        return (T.hash_number(F.lit(name), F.col("id")) % 1000) / 1000.0 - 0.5

    signal = noise("a") + noise("b")
    return cut_lineage(spark.range(n).select(
        F.col("id").cast("string").alias("prefix_id"), (F.col("id") % 60).cast("string").alias("instance_id"),
        noise("a").alias("f__a"), noise("b").alias("f__b"), noise("c").alias("f__c"),
        (signal + 0.6 * noise("d") > 0).cast("bigint").alias("y_fail")))


def test_signal_is_learned_and_models_can_be_stored(spark, tmp_path):
    rows = planted(spark)
    train, test = rows.where("cast(instance_id as int) < 40"), rows.where("cast(instance_id as int) >= 40")
    model = MD.fit("logistic_regression", train, iterations=20)
    auc = M.roc_auc(model.score(test)).first().auc
    assert auc > 0.85
    assert M.roc_auc(MD.fit("baseline_majority", train).score(test)).first().auc == 0.5
    model.save(str(tmp_path / "m"))
    again = MD.RiskModel.load(str(tmp_path / "m"))
    assert abs(M.roc_auc(again.score(test)).first().auc - auc) < 1e-12
    assert {r.feature for r in MD.importance(model).limit(2).collect()} == {"a", "b"}


def test_shuffled_labels_keep_their_number_and_lose_their_meaning(spark):
    """One permutation of three features can rank well by chance, so the labels themselves are checked."""
    rows = planted(spark)
    base = rows.agg(F.avg("y_fail")).first()[0]
    for seed in (42, 7):
        got = shuffled_labels(rows, seed=seed).agg(
            F.avg("y_shuffled").alias("rate"), F.avg((F.col("y_shuffled") == F.col("y_fail")).cast("double")).alias("same")).first()
        assert abs(got.rate - base) < 1e-12
        assert abs(got.same - (base ** 2 + (1 - base) ** 2)) < 0.05


def test_out_of_fold_scores_every_row_once(spark):
    rows = planted(spark, 300)
    scored = MD.out_of_fold(rows, "logistic_regression", k=2, iterations=10)
    assert scored.count() == 300 and scored.select("prefix_id").distinct().count() == 300


def test_every_roster_model_and_calibrator_loads_back(spark, tmp_path):
    rows = planted(spark, 300).withColumn("f__text_blob", F.when(F.col("f__a") > 0, "good fine word").otherwise("bad poor word"))
    small = {"baseline_step_count_only": {"columns": ["f__a"], "iterations": 5}, "logistic_regression": {"iterations": 5},
             "random_forest": {"trees": 3}, "structured_plus_tfidf_logistic": {"iterations": 5}, "gradient_boosting": {"rounds": 5}}
    for k, name in enumerate(MD.ROSTER):
        model = MD.fit(name, rows, **small.get(name, {}))
        calibrator = fit_calibrator(model.score(rows), ["isotonic", "platt", "none"][k % 3])
        MD.save_bundle(str(tmp_path / name), model, calibrator)
        loaded, applied = MD.load_bundle(str(tmp_path / name))
        assert (loaded.name, loaded.columns) == (name, model.columns)
        pair = calibrator.apply(model.score(rows)).select("prefix_id", "risk", "calibrated").join(
            applied.apply(loaded.score(rows)).select("prefix_id", F.col("risk").alias("r"), F.col("calibrated").alias("c")), "prefix_id")
        assert pair.where("abs(risk - r) > 1e-12 or abs(calibrated - c) > 1e-12").count() == 0 and pair.count() == 300


def test_boosted_folds_of_many_sets_in_one_pass(spark):
    rows = planted(spark, 300).withColumn("half", F.col("prefix_id").cast("int") % 2)
    scored = MD.out_of_fold(rows, "gradient_boosting", k=2, by=["half"], rounds=10)
    aucs = {r["half"]: r["auc"] for r in M.roc_auc(scored, by=["half"]).collect()}
    assert scored.count() == 300 and set(aucs) == {0, 1} and min(aucs.values()) > 0.7


def test_greedy_folds_equal_the_plain_rule():
    rng = random.Random(3)
    for _ in range(60):
        k = rng.randint(1, 6)
        sizes = Counter(rng.choice([1, 1, 2, 3, 7, 50, 1000]) for _ in range(rng.randint(1, 300)))
        loads, want = [0] * k, Counter()
        for size in sorted(sizes.elements(), reverse=True):
            f = min(range(k), key=lambda x: (loads[x], x))
            loads[f] += size
            want[size, f] += 1
        assert {(s, f): n for s, f, n in greedy_shares(list(sizes.items()), k)} == dict(want)
