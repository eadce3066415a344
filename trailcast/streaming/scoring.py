"""A fitted model and its calibrator between the feature stream and the alert policy.

Models are published as numbered versions in a shared folder. Every micro-batch takes the newest version
that is there when it starts, scores its features and writes them under its own number, so a batch that is
run again replaces what it wrote; the policy stream reads these files and drops repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from trailcast.operators import interventions as IV
from trailcast.operators.calibration import Calibrator
from trailcast.operators.models import RiskModel, load_bundle, save_bundle
from trailcast.operators.prefixes import FEATURE_PREFIX
from trailcast.streaming import alert_policy as AP

SCORED = ("trajectory_id string, prefix_step bigint, risk double, calibrated double, kind string, message string, "
          "target_command string, model_version bigint")


def publish(spark: SparkSession, folder: str, version: int, model: RiskModel, calibrator: Calibrator | None = None) -> None:
    """Store a version; it is in use from the next micro-batch on."""
    save_bundle(f"{folder}/v{version}", model, calibrator)
    spark.createDataFrame([(version, f"v{version}")], "version bigint, place string").coalesce(1).write.mode("append").parquet(
        f"{folder}/versions")


def newest(spark: SparkSession, folder: str) -> tuple[int, RiskModel, Calibrator]:
    last = spark.read.schema("version bigint, place string").parquet(f"{folder}/versions").orderBy(
        F.col("version").desc()).first()
    if last is None:
        raise ValueError(f"no model in {folder}")
    return last.version, *load_bundle(f"{folder}/{last.place}")


def score_features(features: DataFrame, version: int, model: RiskModel, calibrator: Calibrator) -> DataFrame:
    """Risk, calibrated risk and the intervention it would call for, of every row of features."""
    named = features.select("trajectory_id", "prefix_step", "recent_commands", *[
        F.col(c).alias(FEATURE_PREFIX + c) for c in features.columns if c not in ("trajectory_id", "recent_commands")])
    decided = IV.decide(calibrator.apply(model.score(named)), "calibrated")
    return decided.withColumn("model_version", F.lit(version).cast("bigint")).select(*[c.split()[0] for c in SCORED.split(", ")])


def scoring(features: DataFrame, models: str, folder: str, judged: Column | None = None) -> DataStreamWriter:
    """Writer of the scored steps of a feature stream to ``folder``/scored; ``judged`` picks the steps to score."""
    rows = features if judged is None else features.where(judged)
    AP.keyed_state(features.sparkSession)

    def batch(part: DataFrame, number: int) -> None:
        scored = score_features(part, *newest(part.sparkSession, models))
        scored.write.mode("overwrite").parquet(f"{folder}/scored/batch={number}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/scored-progress")


def verdicts_to_end(spark: SparkSession, features: DataFrame, models: str, folder: str, policy: AP.AlertPolicy,
                    judged: Column | None = None) -> DataFrame:
    """Score and judge all that is there; the verdicts next to what the model said."""
    scoring(features, models, folder, judged).trigger(availableNow=True).start().awaitTermination()
    scored = AP.open_steps(spark, f"{folder}/scored", SCORED + ", batch bigint")
    acting = scored.select("trajectory_id", "prefix_step", F.col("calibrated").alias("risk"),
                           (F.col("kind") != "none").cast("bigint").alias("act"))
    judged_rows = AP.run_to_end(AP.verdict_stream(acting, policy), f"{folder}/policy")
    said = spark.read.schema(SCORED + ", batch bigint").parquet(f"{folder}/scored").drop("batch", "risk").dropDuplicates(
        ["trajectory_id", "prefix_step"])
    return judged_rows.drop("risk").join(said, ["trajectory_id", "prefix_step"])
