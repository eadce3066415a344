"""Selective prediction: commit only where the prefix can be judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trailcast.functions import text as T
from trailcast.operators.metrics import at_false_alarm_rate, auc_of_histogram, histogram, roc_auc
from trailcast.operators.ordering import attach, number_rows, text_bucket

STEP_FLOORS = [0, 3, 5, 8, 10, 15, 20, 25, 30]
# 19 coverages from 10 % to 100 %.
COVERAGES = [0.1 + i * (0.9 / 18) for i in range(18)] + [1.0]


def confidence(risk: Column) -> Column:
    return F.abs(risk - 0.5)


def committed(step: Column, risk: Column, step_floor: int, conf_floor: float) -> Column:
    return (step >= step_floor) & (confidence(risk) >= conf_floor)


def _coverage_aucs(ranked: DataFrame, n_rows: DataFrame, by: list[str]) -> DataFrame:
    """AUC over the first k rows for every coverage.

    A row enters the histogram of the smallest coverage that keeps it; the histograms
    (not the rows) are then added up over the coverages.
    """
    sizes = n_rows.select(
        F.col("n_rows"),
        F.array(*[F.greatest(F.lit(1), F.bround(F.lit(c) * F.col("n_rows"), 0)).cast("bigint")
                  for c in COVERAGES]).alias("ks"))
    placed = attach(ranked, sizes).withColumn(
        "place", F.size(F.filter("ks", lambda k: k < F.col("row_no"))))
    h = histogram(placed, by=[*by, "place"])
    spread = h.withColumn("place", F.explode(F.sequence(F.col("place"), F.lit(len(COVERAGES) - 1))))
    merged = spread.groupBy(*by, "place", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    aucs = auc_of_histogram(merged, [*by, "place"]).where(F.col("auc").isNotNull())
    return attach(aucs, sizes).select(
        *by, F.element_at("ks", F.col("place") + 1).alias("n"), "auc", "n_rows")


def selective_curve(df: DataFrame) -> DataFrame:
    """AUC over the most confident share of rows, by coverage."""
    order = [confidence(F.col("risk")).desc(), F.col("prefix_id")]
    ranked = number_rows(df.select("prefix_id", "risk", "y_fail"), order,
                         F.floor((0.5 - confidence(F.col("risk"))) * 8192).cast("bigint"))
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return _coverage_aucs(ranked, n, []).select(
        (F.col("n") / F.col("n_rows")).alias("coverage"), "auc", "n").distinct()


def random_curve(df: DataFrame, repeats: int = 5, seed: int = 42) -> DataFrame:
    """Mean AUC over random shares of rows: the level selective prediction has to beat."""
    spread = df.select("prefix_id", "risk", "y_fail", F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.lit(repeats - 1).cast("bigint"))).alias("rep"))
    spread = spread.withColumn("_h", T.hash_key(F.lit(seed), F.col("rep"), F.col("prefix_id")))
    ranked = number_rows(spread, [F.col("_h"), F.col("prefix_id")], text_bucket(F.col("_h")), by=["rep"])
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return _coverage_aucs(ranked, n, ["rep"]).distinct().groupBy("n", "n_rows").agg(F.avg("auc").alias("auc")).select(
        (F.col("n") / F.col("n_rows")).alias("coverage"), "auc", "n")


def step_gate_curve(df: DataFrame, floors: list[int] | None = None, min_rows: int = 50) -> DataFrame:
    """AUC over the prefixes at or beyond each step floor."""
    floors = floors or STEP_FLOORS
    passed = F.filter(F.array(*[F.lit(f).cast("bigint") for f in floors]), lambda f: f <= F.col("prefix_step"))
    h = df.withColumn("floors", passed).groupBy("floors", F.col("risk").alias("score")).agg(
        F.sum(F.col("y_fail").cast("bigint")).alias("pos"), F.sum(1 - F.col("y_fail").cast("bigint")).alias("neg"))
    per = h.select(F.explode("floors").alias("step_floor"), "score", "pos", "neg").groupBy(
        "step_floor", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    aucs = auc_of_histogram(per, ["step_floor"]).withColumn("n", F.col("n_pos") + F.col("n_neg"))
    total = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return attach(aucs, total).where((F.col("n") >= min_rows) & F.col("auc").isNotNull()).select(
        "step_floor", (F.col("n") / F.col("n_rows")).alias("coverage"), "auc", "n")


def confidence_floor(validation: DataFrame, step_floor: int = 10) -> DataFrame:
    """(conf_floor): median confidence of the validation prefixes past the step floor."""
    conf = validation.where(F.col("prefix_step") >= step_floor).groupBy(
        confidence(F.col("risk")).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return conf.agg(F.coalesce(F.percentile("c", 0.5, F.col("n")), F.lit(0.0)).alias("conf_floor"))


def operating_point(validation: DataFrame, test: DataFrame, step_floor: int = 10, far: float = 0.10) -> DataFrame:
    """Gate chosen on validation, applied to test: coverage, AUC, precision and recall."""
    gate = confidence_floor(validation, step_floor)
    kept = attach(test, gate).where(
        (F.col("prefix_step") >= step_floor) & (confidence(F.col("risk")) >= F.col("conf_floor")))
    total = test.agg(F.count(F.lit(1)).alias("n_rows"))
    out = attach(attach(attach(gate, total), roc_auc(kept)), at_false_alarm_rate(kept, far))
    n = F.col("n_pos") + F.col("n_neg")
    return out.select(
        F.lit(step_floor).cast("bigint").alias("step_floor"), "conf_floor",
        (n / F.col("n_rows")).alias("test_coverage"), F.when(n > 50, F.col("auc")).alias("test_auc"),
        F.col("precision").alias("precision_at_far"), F.col("recall").alias("recall_at_far"))
