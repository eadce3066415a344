"""Small report aggregations shared by several jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trailcast.operators.metrics import auc_of_histogram
from trailcast.operators.ordering import attach


def frequency(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Counts and shares of a column's values, with a readable ``16 (40%)`` text."""
    by = by or []
    counts = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    joined = counts.join(totals, by) if by else attach(counts, totals)
    share = F.col("n") / F.col("total")
    return joined.select(
        *by, column, "n", share.alias("share"),
        F.concat(F.col("n").cast("string"), F.lit(" ("), F.bround(share * 100, 0).cast("bigint").cast("string"),
                 F.lit("%)")).alias("label"))


def position(step: Column, total: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), step / F.greatest(F.lit(1).cast("bigint"), total)))


def position_profile(df: DataFrame, n_bins: int = 10) -> DataFrame:
    """Mean risk by outcome and normalized position bin."""
    place = F.least(F.floor(position(F.col("prefix_step"), F.col("n_total_steps")) * n_bins),
                    F.lit(n_bins - 1)).cast("bigint")
    return df.groupBy("y_fail", place.alias("bin")).agg(
        F.avg("risk").alias("mean_risk"), F.count(F.lit(1)).alias("n")).withColumn(
        "pos_center", (F.col("bin") + 0.5) / n_bins)


def stratum(step: Column, total: Column) -> Column:
    p = step / F.greatest(F.lit(1).cast("bigint"), total)
    return F.when(p <= 0.33, "early").when(p <= 0.66, "mid").otherwise("late")


def position_strata_auc(df: DataFrame, score: str = "risk") -> DataFrame:
    """AUC of early, middle and late prefixes and of all of them, in one pass."""
    s = stratum(F.col("prefix_step"), F.col("n_total_steps"))
    h = df.withColumn("stratum", s).groupBy("stratum", F.col(score).alias("score")).agg(
        F.sum(F.col("y_fail").cast("bigint")).alias("pos"), F.sum(1 - F.col("y_fail").cast("bigint")).alias("neg"))
    both = h.withColumn("stratum", F.explode(F.array(F.col("stratum"), F.lit("overall")))).groupBy(
        "stratum", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return auc_of_histogram(both, ["stratum"])


def trouble_share(df: DataFrame) -> DataFrame:
    """Share of failed prefixes with visible trouble, by position; ``df`` has ``trouble``."""
    s = stratum(F.col("prefix_step"), F.col("n_total_steps"))
    return df.where(F.col("y_fail") == 1).groupBy(s.alias("stratum")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("trouble").cast("double")).alias("trouble_share"))


def run_success_rate(df: DataFrame, by: list[str]) -> DataFrame:
    """Success rate over runs (not prefixes) with the number of instances."""
    per_run = df.groupBy(*by, "trajectory_id").agg(
        F.max("y_fail").alias("y_fail"), F.first("instance_id").alias("instance_id"))
    return per_run.groupBy(*by).agg(
        (1 - F.avg(F.col("y_fail").cast("double"))).alias("success_rate"),
        F.count(F.lit(1)).alias("n_runs"), F.count_distinct("instance_id").alias("n_instances"))


def latency(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Median, p10, p90 and throughput of a timing log in milliseconds.

    Percentiles are taken over counted distinct values.
    """
    counted = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*by).agg(
        F.percentile(value, 0.5, F.col("n")).alias("median_ms"), F.percentile(value, 0.1, F.col("n")).alias("p10_ms"),
        F.percentile(value, 0.9, F.col("n")).alias("p90_ms"), F.sum("n").alias("n"),
        (1000.0 * F.sum("n") / F.sum(F.col(value) * F.col("n"))).alias("per_second"))


def cost_table(runs: DataFrame, specs: DataFrame) -> DataFrame:
    """Resources by model and policy. ``specs`` is a short lookup table by model."""
    g = runs.groupBy("model", "policy").agg(
        F.avg("runtime_s").alias("runtime"), F.avg("total_tokens_approx").alias("tokens"),
        F.avg("n_steps").alias("avg_steps"), F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.count(F.lit(1)).alias("n_runs"))
    joined = g.join(specs, "model", "left")
    return joined.select(
        "model", "policy", F.coalesce("model_size", F.lit("?")).alias("model_size"),
        F.coalesce("context_window", F.lit("?")).alias("context_window"),
        F.coalesce(F.try_divide("tokens", "runtime"), F.lit(0.0)).alias("avg_tokens_per_sec"),
        F.col("runtime").alias("avg_run_time_s"), "avg_steps", "success_rate", "n_runs")
