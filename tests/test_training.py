"""Settings that the training queries hand to the operators."""

from pyspark.sql import functions as F

from trailcast.plans import training


def test_matched_budget_uses_the_full_resampling(spark, monkeypatch):
    rows = spark.range(140).select(
        F.lit("m0").alias("model_name"), F.col("id").cast("string").alias("instance_id"),
        F.col("id").cast("string").alias("trajectory_id"), F.col("id").cast("string").alias("prefix_id"),
        F.lit(1).alias("prefix_step"), (F.col("id") % 2).alias("y_fail"))
    calls = []

    def out_of_fold(df, name, k=5, by=None, **settings):
        sizes = df.groupBy(*by).agg(F.count_distinct("instance_id").alias("n")).collect()
        calls.append(([r.n for r in sizes], name, k, settings))
        return df.withColumn("risk", F.rand(1))

    monkeypatch.setattr(training, "prefixes", lambda spark, sf: rows)
    monkeypatch.setattr(training.MD, "out_of_fold", out_of_fold)
    monkeypatch.setattr(training, "run_success_rate", lambda p, by: p.select(*by).distinct())
    training.matched_budget_monitorability(spark, "")
    assert calls == [([60] * 20, "gradient_boosting", 5, {"rounds": 100, "rate": 0.1, "l2": 0.0})]


def test_ablation_has_the_text_family_and_the_boosted_model(spark, sf_dir, monkeypatch):
    calls = []
    monkeypatch.setattr(training.RP, "ablation_table", lambda *a, **kw: calls.append((a, kw)))
    training.feature_ablation_table(spark, sf_dir)
    (train, _, _, families, *rest), settings = calls[0]
    assert len(families) == 9 and ["all_structured_plus_text"] in families
    assert training.MD.TEXT_COLUMN in train.columns
    assert not rest and not settings
