"""Exact ranking, calibration and threshold metrics as aggregations.

Rows are first counted per distinct score, so ties are exact and the data that is
ordered is the score histogram. The histogram is ordered in buckets
(:mod:`trailcast.operators.ordering`); no step sorts all scores in one task.
All functions take ``by`` to compute one result per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trailcast.operators.ordering import attach, number_rows, real_bucket, running_total

# Inner edges of ten equal bins as binary fractions of ten.
BIN_EDGES = [0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001,
             0.7000000000000001, 0.8, 0.9]


def histogram(df: DataFrame, score: str = "risk", label: str = "y_fail", by: list[str] | None = None,
              weight: Column | None = None) -> DataFrame:
    """(by, score) with the number of positive and negative rows."""
    w = F.lit(1).cast("bigint") if weight is None else weight
    return df.groupBy(*(by or []), F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0)).cast("bigint").alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(w)).cast("bigint").alias("neg"))


def auc_of_histogram(hist: DataFrame, by: list[str] | None = None, bucket: Column | None = None) -> DataFrame:
    """Tie-aware ROC AUC; NULL when a class is missing. Returns (by, auc, n_pos, n_neg)."""
    by = by or []
    b = hist.withColumn("_b", real_bucket(F.col("score")) if bucket is None else bucket)
    inside = Window.partitionBy(*by, "_b").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("_below", F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    parts = b.groupBy(*by, "_b").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
        F.sum(F.col("pos") * (F.col("_below").cast("double") + F.col("neg") / 2.0)).alias("wins"))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_below", F.coalesce(F.sum("neg").over(earlier), F.lit(0)))
    out = parts.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        F.sum(F.col("wins") + F.col("pos") * F.col("_below").cast("double")).alias("wins"))
    return out.select(
        *by,
        F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
               F.col("wins") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("auc"),
        F.coalesce("n_pos", F.lit(0)).alias("n_pos"), F.coalesce("n_neg", F.lit(0)).alias("n_neg"))


def roc_auc(df: DataFrame, score: str = "risk", label: str = "y_fail", by: list[str] | None = None) -> DataFrame:
    return auc_of_histogram(histogram(df, score, label, by), by)


def curve(df: DataFrame, score: str = "risk", label: str = "y_fail", by: list[str] | None = None) -> DataFrame:
    """(by, score, pos, neg, tp, fp): counts at or above each distinct score."""
    h = histogram(df, score, label, by)
    run = running_total(h, "score", ["pos", "neg"], real_bucket(F.col("score")), by, descending=True)
    return run.select(
        *(by or []), "score", "pos", "neg",
        (F.col("pos_before") + F.col("pos")).alias("tp"), (F.col("neg_before") + F.col("neg")).alias("fp"))


def average_precision(df: DataFrame, score: str = "risk", label: str = "y_fail",
                      by: list[str] | None = None) -> DataFrame:
    """Step-sum average precision: precision at each score weighted by the gain in recall."""
    return curve(df, score, label, by).groupBy(*(by or [])).agg(
        (F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("pos")).alias("average_precision"))


def average_rank(df: DataFrame, score: str, name: str, by: list[str] | None = None) -> DataFrame:
    """(by, score, name): the rank every row of a score gets, ties sharing their mean rank."""
    by = by or []
    h = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("ties"))
    run = running_total(h, score, ["ties"], real_bucket(F.col(score)), by)
    return run.select(*by, score, (F.col("ties_before") + (F.col("ties") + 1) / 2.0).alias(name))


def ten_bin(p: Column) -> Column:
    """Bin number 0..9 against the literal edges, so values on an edge go up."""
    n = F.lit(0).cast("bigint")
    for edge in BIN_EDGES:
        n = n + (p >= F.lit(edge)).cast("bigint")
    return n


def reliability(df: DataFrame, score: str = "risk", label: str = "y_fail",
                by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), ten_bin(F.col(score)).alias("bin")).agg(
        F.avg(score).alias("mean_predicted"),
        F.avg(F.col(label).cast("double")).alias("observed_freq"),
        F.count(F.lit(1)).alias("count"))


def calibration_error(df: DataFrame, score: str = "risk", label: str = "y_fail",
                      by: list[str] | None = None) -> DataFrame:
    """Expected calibration error over ten equal bins."""
    return reliability(df, score, label, by).groupBy(*(by or [])).agg(
        (F.sum(F.col("count") * F.abs(F.col("mean_predicted") - F.col("observed_freq")))
         / F.sum("count")).alias("ece"))


def _join(by: list[str], frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, by) if by else attach(out, f)
    return out


def metric_bundle(df: DataFrame, score: str = "risk", label: str = "y_fail",
                  by: list[str] | None = None) -> DataFrame:
    """n, positive rate, ROC AUC, average precision, Brier score and ECE per group.

    With one class only, the ranking metrics are NULL.
    """
    by = by or []
    simple = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("pos_rate"),
        F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"))
    out = _join(by, [simple, roc_auc(df, score, label, by),
                     average_precision(df, score, label, by), calibration_error(df, score, label, by)])
    return out.select(
        *by, "n", "pos_rate", F.col("auc").alias("roc_auc"),
        F.when(F.col("auc").isNotNull(), F.col("average_precision")).alias("auprc"), "brier", "ece")


def at_false_alarm_rate(df: DataFrame, far: float, score: str = "risk", label: str = "y_fail",
                        by: list[str] | None = None) -> DataFrame:
    """Precision and recall at the lowest score whose false-positive rate is within ``far``.

    Every distinct score is a candidate. Without a feasible one both values are 0.
    """
    by = by or []
    c = curve(df, score, label, by)
    totals = histogram(df, score, label, by).groupBy(*by).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    c = _join(by, [c, totals])
    ok = F.col("fp") <= F.lit(far) * F.col("n_neg")
    best = c.groupBy(*by).agg(
        F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"),
        F.min_by(F.struct("score", "tp", "fp"), F.when(ok, F.col("score"))).alias("b"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return best.select(
        *by, F.lit(far).alias("far"), F.when(both, F.col("b.score")).alias("threshold"),
        F.when(both, F.coalesce(F.col("b.tp") / (F.col("b.tp") + F.col("b.fp")), F.lit(0.0))).alias("precision"),
        F.when(both, F.coalesce(F.col("b.tp") / F.col("n_pos"), F.lit(0.0))).alias("recall"),
        F.when(both, F.coalesce(F.col("b.fp") / F.col("n_neg"), F.lit(0.0))).alias("fpr_actual"))


def pr_curve(df: DataFrame, points: int = 300, score: str = "risk", label: str = "y_fail") -> DataFrame:
    """Precision–recall points from low to high score, thinned to about ``points``.

    Ends with the conventional (1, 0) point, which counts as a row when thinning.
    """
    c = curve(df, score, label)
    sizes = c.agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("n_pos"))
    numbered = number_rows(c, [F.col("score")], real_bucket(F.col("score")))
    numbered = attach(numbered, sizes)
    every = F.greatest(F.lit(1).cast("bigint"), F.floor((F.col("n") + 1) / points).cast("bigint"))
    body = numbered.select(
        F.col("row_no").alias("point"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / F.col("n_pos")).alias("recall"), every.alias("every"))
    end = sizes.select((F.col("n") + 1).alias("point"), F.lit(1.0).alias("precision"),
                       F.lit(0.0).alias("recall"), every.alias("every"))
    return body.unionByName(end).where((F.col("point") - 1) % F.col("every") == 0).drop("every")
