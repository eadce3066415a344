"""Reproducible samples: order by a hash, keep the first rows per group.

``row_number() <= k`` filters are pruned before the shuffle, so a group of any size
sends at most k rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trailcast.functions import text as T
from trailcast.operators.ordering import attach, number_rows, text_bucket


def first_per_group(df: DataFrame, groups: list[str], k: int | Column, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def stratified(df: DataFrame, group: str, label: str, max_positive: int, max_negative: int, key: list[str],
               seed: int = 42, max_groups: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """At most so many successes and failures per group, optionally for some groups only."""
    if allowed is not None:
        df = df.join(allowed.select(group).distinct(), group, "left_semi")
    if max_groups is not None:
        chosen = df.select(group).distinct().orderBy(T.hash_key(F.lit(seed), F.col(group)), group).limit(max_groups)
        df = df.join(chosen, group, "left_semi")
    cap = F.when(F.col(label) == 1, max_positive).otherwise(max_negative)
    order = [T.hash_key(F.lit(seed), *[F.col(c) for c in key]), *[F.col(c) for c in key]]
    w = Window.partitionBy(group, label).orderBy(*order)
    top = max(max_positive, max_negative)
    ranked = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= top)
    return ranked.where(F.col("_rn") <= cap).drop("_rn")


def balanced(df: DataFrame, n: int, label: str = "y_fail", key: str = "prefix_id", seed: int = 42) -> DataFrame:
    """``n`` rows, half of them positive; negatives fill what positives cannot."""
    order = [T.hash_key(F.lit(seed), F.col(key)), F.col(key)]
    positives = df.where(F.col(label) == 1).orderBy(*order).limit(n // 2)
    taken = positives.agg(F.count(F.lit(1)).alias("_taken"))
    negatives = df.where(F.col(label) == 0).orderBy(*order).limit(n)
    ranked = negatives.withColumn("_rn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    kept = attach(ranked, taken).where(F.col("_rn") <= n - F.col("_taken")).drop("_rn", "_taken")
    return positives.unionByName(kept)


def shuffled(df: DataFrame, key: str, seed: int = 42, name: str = "shuffle_no") -> DataFrame:
    """Number the rows in a reproducible random order."""
    h = T.hash_key(F.lit(seed), F.col(key))
    return number_rows(df.withColumn("_h", h), [F.col("_h"), F.col(key)], text_bucket(F.col("_h")), name).drop("_h")


def half(df: DataFrame, key: str, seed: int = 42, name: str = "first_half") -> DataFrame:
    """Flag the first half of the rows in hash order."""
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return attach(shuffled(df, key, seed, "_no"), total).withColumn(
        name, (F.col("_no") <= F.floor(F.col("_total") / 2)).cast("bigint")).drop("_no", "_total")


def one_per_run(df: DataFrame, by: list[Column], run: str = "trajectory_id") -> DataFrame:
    """The row with the highest ``by`` of every run; partial maxima travel, not rows."""
    packed = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(run).agg(F.max_by(packed, F.struct(*by)).alias("_row")).select("_row.*")


def subsets(units: DataFrame, key: str, k: int, repeats: int, seed: int = 0) -> DataFrame:
    """``repeats`` random subsets of ``k`` units: (rep, key).

    Each unit is repeated and the k lowest hashes per repeat are kept; the limit is
    applied per task before the shuffle.
    """
    spread = units.select(key).distinct().withColumn(
        "rep", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(repeats - 1).cast("bigint"))))
    order = [T.hash_key(F.lit(seed), F.col("rep"), F.col(key)), F.col(key)]
    return first_per_group(spread, ["rep"], k, order).select("rep", key)


def deduplicated(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return first_per_group(df, [key], 1, order)


def top_by_risk(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.col("risk").desc(), F.col("prefix_id")).limit(n)
