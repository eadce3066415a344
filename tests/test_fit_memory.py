"""The rows of a fit are kept only while it runs."""

from pyspark.sql import functions as F

from trailcast.operators import models as MD
from trailcast.session import cut_lineage


def test_folds_do_not_pile_up_in_memory(spark):
    rows = cut_lineage(spark.range(200).select(
        F.col("id").cast("string").alias("prefix_id"), (F.col("id") % 20).alias("instance_id"), (F.col("id") % 7).alias("f__a"),
        ((F.col("id") * 13 % 11 + F.col("id") % 7) > 8).cast("bigint").alias("y_fail")))
    kept = spark.sparkContext._jsc.getPersistentRDDs
    before = set(kept())
    scored = MD.out_of_fold(rows, "logistic_regression", k=4, iterations=3)
    assert len(set(kept()) - before) <= 1  # the folded table itself
    assert scored.count() == 200
