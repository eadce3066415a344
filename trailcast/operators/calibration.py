"""Probability calibration, always fitted on validation scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from trailcast.operators.isotonic import blocks
from trailcast.operators.metrics import histogram


@dataclass
class Calibrator:
    """Maps a score column to a probability."""

    method: str
    model: LogisticRegressionModel | IsotonicRegressionModel | None = None

    def apply(self, df: DataFrame, score: str = "risk", out: str = "calibrated") -> DataFrame:
        if self.model is None:
            return df.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score))))
        if self.method == "platt":
            rows = VectorAssembler(inputCols=[score], outputCol="_v").transform(df)
            return self.model.transform(rows).select(*df.columns, vector_to_array("_p")[1].alias(out))
        # Beyond the fitted range the model repeats its end values.
        fitted = self.model.transform(df.withColumn("_s", F.col(score).cast("double")))
        return fitted.select(*df.columns, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_p"))).alias(out))

    def save(self, path: str) -> None:
        write_text(SparkSession.active(), self.method, f"{path}/method")
        if self.model is not None:
            self.model.write().overwrite().save(f"{path}/fitted")

    @staticmethod
    def load(path: str) -> Calibrator:
        method = read_text(SparkSession.active(), f"{path}/method")
        if method == "identity":
            return Calibrator(method)
        kind = LogisticRegressionModel if method == "platt" else IsotonicRegressionModel
        return Calibrator(method, kind.load(f"{path}/fitted"))


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One line of text in a folder that all of the cluster can read."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path).first()[0]


def fit_calibrator(df: DataFrame, method: str = "isotonic", score: str = "risk", label: str = "y_fail") -> Calibrator:
    """Fit on counted distinct scores; the identity for ``none`` and for one class only."""
    if method in ("none", "identity"):
        return Calibrator("identity")
    h = histogram(df, score, label)
    totals = h.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).first()
    if not totals.pos or not totals.neg:
        return Calibrator("identity")
    if method == "platt":
        rows = h.select("score", F.explode(F.array(
            F.struct(F.lit(1.0).alias("y"), F.col("pos").cast("double").alias("w")),
            F.struct(F.lit(0.0).alias("y"), F.col("neg").cast("double").alias("w")))).alias("x")).select(
            "score", "x.y", "x.w").where("w > 0")
        rows = VectorAssembler(inputCols=["score"], outputCol="_v").transform(rows)
        n = totals.pos + totals.neg
        model = LogisticRegression(featuresCol="_v", labelCol="y", weightCol="w", probabilityCol="_p",
                                   rawPredictionCol="_r", predictionCol="_c", maxIter=1000,
                                   regParam=1.0 / n, standardization=False).fit(rows)
        return Calibrator(method, model)
    if method == "isotonic":
        # Both ends of each block: a table as small as the fitted steps.
        value = F.col("pos") / F.col("n")
        rows = blocks(h).select(F.explode(F.array(*[F.struct(F.col(e).alias("_s"), value.alias("y"), F.col("n").cast(
            "double").alias("w")) for e in ("lo", "hi")])).alias("x")).select("x.*").distinct()
        model = IsotonicRegression(featuresCol="_s", labelCol="y", weightCol="w", predictionCol="_p").fit(rows)
        return Calibrator(method, model)
    raise ValueError(f"unknown calibration method {method!r}")
