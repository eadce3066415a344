"""Domain shift: aligning feature distributions and reporting transfer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trailcast.operators.metrics import average_rank, calibration_error, roc_auc
from trailcast.operators.ordering import attach, real_bucket, running_total
from trailcast.operators.sampling import one_per_run


def _long(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    return df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("v"))
        for c in columns])).alias("x")).select(*keys, "x.feature", "x.v")


def quantile_map(source: DataFrame, target: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, v, aligned): each distinct target value and the source value at its quantile.

    Works on the distinct values of both sides. A target value at percentile p takes
    the linear quantile p of the source; the two source rows that surround it are found
    by an equi-join on row number ranges cut into equal pieces.
    """
    t = _long(target, columns, [])
    s = _long(source, columns, []).groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n"))
    n_t = target.agg(F.count(F.lit(1)).alias("n_t"))
    n_s = source.agg(F.count(F.lit(1)).alias("n_s"))
    ranks = attach(attach(average_rank(t, "v", "rank", ["feature"]), n_t), n_s)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("rank") - 0.5) / F.col("n_t")))
    places = ranks.select("feature", "v", (share * (F.col("n_s") - 1)).alias("place"), "n_s").withColumn(
        "row", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place"))))).withColumn(
        "piece", piece(F.col("row"), F.col("n_s")))
    rows = attach(running_total(s, "v", ["n"], real_bucket(F.col("v")), ["feature"]), n_s)
    first, last = F.col("n_before"), F.col("n_before") + F.col("n") - 1
    spread = rows.select("feature", F.col("v").alias("source_v"), first.alias("first"), last.alias("last"), F.explode(
        F.sequence(piece(first, F.col("n_s")), piece(last, F.col("n_s")))).alias("piece"))
    found = places.join(spread, ["feature", "piece"]).where("row >= first AND row <= last")
    ends = found.groupBy("feature", "v").agg(
        F.min("source_v").alias("lo"), F.max("source_v").alias("hi"), F.max(F.col("place") - F.floor("place")).alias("part"))
    return ends.select("feature", "v", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("aligned"))


PIECES = 1024


def piece(row: Column, n: Column) -> Column:
    return F.floor(row * PIECES / n).cast("bigint")


def align(source: DataFrame, target: DataFrame, columns: list[str], key: str = "prefix_id") -> DataFrame:
    """Target rows with every feature moved to the source distribution."""
    mapping = quantile_map(source, target, columns)
    moved = _long(target, columns, [key]).join(mapping, ["feature", "v"]).groupBy(key).agg(*[
        F.max(F.when(F.col("feature") == c, F.col("aligned"))).alias(c) for c in columns])
    return target.drop(*columns).join(moved, key)


def rank_ensemble(df: DataFrame, scores: list[str], key: str = "prefix_id") -> DataFrame:
    """Sum of the average ranks of several scores (``ensemble``)."""
    out = df
    for c in scores:
        out = out.join(average_rank(df, c, f"_r_{c}"), c)
    total = F.lit(0.0)
    for c in scores:
        total = total + F.col(f"_r_{c}")
    return out.withColumn("ensemble", total).drop(*[f"_r_{c}" for c in scores])


def last_prefix_auc(df: DataFrame, score: str = "risk") -> DataFrame:
    """AUC when each run is judged once, at its last prefix."""
    rows = one_per_run(df.select("trajectory_id", "prefix_step", "y_fail", score), [F.col("prefix_step")])
    return roc_auc(rows, score)


def gated_auc(df: DataFrame, floors: list[int], score: str = "risk", min_rows: int = 50) -> DataFrame:
    """AUC and coverage of the prefixes at or beyond each floor."""
    passed = F.filter(F.array(*[F.lit(f).cast("bigint") for f in floors]), lambda f: f <= F.col("prefix_step"))
    rows = df.withColumn("step_floor", F.explode(passed))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return attach(roc_auc(rows, score, by=["step_floor"]), total).where(
        F.col("n_pos") + F.col("n_neg") > min_rows).select(
        "step_floor", "auc", ((F.col("n_pos") + F.col("n_neg")) / F.col("total")).alias("coverage"))


def transfer_report(within: DataFrame, cross: DataFrame, threshold: float) -> DataFrame:
    """AUC inside and across, gap, calibration errors, and firing at the deployed threshold.

    ``within`` has (y_fail, risk); ``cross`` has (y_fail, risk, calibrated, recalibrated, held_out),
    where ``held_out`` marks rows the recalibration did not see.
    """
    ok, bad = F.col("y_fail") == 0, F.col("y_fail") == 1
    fired = (F.col("calibrated") >= threshold).cast("double")
    out = attach(
        roc_auc(within).select(F.col("auc").alias("auc_within")), roc_auc(cross).select(F.col("auc").alias("auc_cross")))
    out = attach(out, calibration_error(cross, "calibrated").select(F.col("ece").alias("ece_naive")))
    out = attach(out, calibration_error(cross.where("held_out"), "recalibrated").select(F.col("ece").alias("ece_recalibrated")))
    out = attach(out, cross.agg(
        F.avg(F.when(ok, F.col("calibrated"))).alias("mean_risk_success"),
        F.avg(F.when(ok, fired)).alias("success_far"), F.avg(F.when(bad, fired)).alias("fail_coverage")))
    return out.withColumn("transfer_gap", F.col("auc_within") - F.col("auc_cross"))


def flatten_capture(captured: DataFrame) -> DataFrame:
    """(y_fail, step, risk) rows of captured runs that hold an array ``risks`` of (step, risk)."""
    return captured.select("y_fail", F.explode("risks").alias("r")).select("y_fail", "r.step", "r.risk")


def over_firing(rows: DataFrame, ungated: float, gated: float, step_floor: int) -> DataFrame:
    """Risk of captured steps by outcome and the share above both alarm bars."""
    return rows.groupBy("y_fail").agg(
        F.count(F.lit(1)).alias("n_prefixes"), F.avg("risk").alias("mean_risk"),
        F.avg((F.col("risk") >= ungated).cast("double")).alias("above_ungated"),
        F.avg(((F.col("step") >= step_floor) & (F.col("risk") >= gated)).cast("double")).alias("above_gated"))


def rank_by_gain(results: DataFrame) -> DataFrame:
    """Experiments ordered by their paired gain."""
    return results.orderBy(F.col("delta").desc(), "experiment")
