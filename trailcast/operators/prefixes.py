"""Prefixes of runs: which step counts are kept, their ids and their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trailcast.functions import patterns as P
from trailcast.functions import text as T
from trailcast.operators.ordering import attach

META = ["prefix_id", "trajectory_id", "instance_id", "model_name",
        "prefix_step", "n_total_steps", "y_fail"]
FEATURE_PREFIX = "f__"
TEXT_COLUMN = "f__text_blob"


def on_schedule(step: Column, total: Column, mode: str = "default") -> Column:
    """Whether a prefix of ``step`` steps is kept for a run of ``total`` steps."""
    if mode == "dense":
        chosen = (step <= 60) | ((step - 60) % 5 == 0)
    elif mode == "sparse":
        chosen = step.isin(1, 3, 5) | (step % 10 == 0)
    else:
        chosen = (step <= 5) | ((step >= 10) & (step % 5 == 0))
    return (step >= 1) & (step <= total) & (chosen | (step == total))


def prefix_id(run: Column, step: Column) -> Column:
    return T.short_id(run, step)


def label_prefixes(rows: DataFrame, runs: DataFrame, mode: str = "default") -> DataFrame:
    """Join run labels to per-step rows (column ``prefix_step``) and keep the scheduled ones."""
    labels = runs.select("trajectory_id", "n_total_steps", "y_fail")
    joined = rows.join(labels, "trajectory_id")
    kept = joined.where(on_schedule(F.col("prefix_step"), F.col("n_total_steps"), mode))
    return kept.withColumn("prefix_id", prefix_id(F.col("trajectory_id"), F.col("prefix_step")))


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric feature columns."""
    return [c for c in df.columns if c.startswith(FEATURE_PREFIX) and c != TEXT_COLUMN]


def ordered_columns(df: DataFrame) -> DataFrame:
    """Meta columns first, sorted features next, text last."""
    text = [TEXT_COLUMN] if TEXT_COLUMN in df.columns else []
    return df.select(*META, *sorted(feature_columns(df)), *text)


def check_no_outcome_columns(columns: list[str]) -> None:
    """Refuse feature names that contain the name of an outcome."""
    bad = [c for c in columns if any(word in c.lower() for word in P.OUTCOME_NAMES)]
    if bad:
        raise ValueError(f"feature columns name outcomes: {bad}")


def step_bound_violations(prefixes: DataFrame) -> DataFrame:
    return prefixes.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(F.col("prefix_step") > F.col("n_total_steps"), 1)).alias("n_violations"),
        F.count(F.when(F.col("prefix_step") < 1, 1)).alias("n_below_one"),
    )


def check_prefixes(prefixes: DataFrame) -> DataFrame:
    """Gate before writing: raise on leaking names, over-long prefixes or repeated ids."""
    check_no_outcome_columns([c for c in prefixes.columns if c.startswith(FEATURE_PREFIX)])
    row = step_bound_violations(prefixes).first()
    if row.n_violations or row.n_below_one:
        raise ValueError(f"{row.n_violations} prefixes are longer than their run")
    if not prefixes.groupBy("prefix_id").count().where("count > 1").isEmpty():
        raise ValueError("prefix_id is not unique")
    return prefixes


def dataset_summary(prefixes: DataFrame) -> DataFrame:
    """One row that describes a prefix table; step quantiles come from a step histogram."""
    per_run = prefixes.groupBy("trajectory_id", "instance_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y_fail").alias("fails"))
    sizes = per_run.agg(
        F.sum("n").alias("n_prefixes"),
        F.count(F.lit(1)).alias("n_runs"),
        F.count_distinct("instance_id").alias("n_instances"),
        F.avg("n").alias("prefixes_per_run"),
        (F.sum("fails") / F.sum("n")).alias("fail_rate"),
    )
    steps = prefixes.groupBy("prefix_step").agg(F.count(F.lit(1)).alias("n")).agg(
        F.min("prefix_step").alias("step_min"),
        F.percentile("prefix_step", 0.5, F.col("n")).alias("step_median"),
        F.max("prefix_step").alias("step_max"),
    )
    return attach(sizes, steps)


def same_prefix_ids(left: DataFrame, right: DataFrame) -> DataFrame:
    """Counts of ids on one side only; both are 0 for a rebuilt table."""
    a = left.select("prefix_id", F.lit(1).alias("l"), F.lit(0).alias("r"))
    b = right.select("prefix_id", F.lit(0).alias("l"), F.lit(1).alias("r"))
    return (
        a.unionByName(b).groupBy("prefix_id").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
        .agg(
            F.count(F.when(F.col("r") == 0, 1)).alias("only_left"),
            F.count(F.when(F.col("l") == 0, 1)).alias("only_right"),
            F.count(F.when((F.col("l") > 0) & (F.col("r") > 0), 1)).alias("in_both"),
        )
    )
