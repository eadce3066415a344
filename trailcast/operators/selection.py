"""Choosing one of K samples per problem (problem_id, k, solved, score, signature, difficulty)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trailcast.operators.metrics import roc_auc
from trailcast.operators.ordering import attach


def per_problem(samples: DataFrame) -> DataFrame:
    """pass@1, pass@K, solve count, and the samples picked by greedy order, score and majority.

    The majority signature is the most frequent one, the first seen on ties.
    """
    votes = samples.groupBy("problem_id", "difficulty", "signature").agg(
        F.count(F.lit(1)).alias("n"), F.sum("solved").alias("solved"), F.min("k").alias("first"),
        F.min_by("solved", "k").alias("first_solved"),
        F.max_by("solved", F.struct(F.col("score"), -F.col("k"))).alias("best_solved"),
        F.max(F.struct(F.col("score"), -F.col("k"))).alias("best"))
    return votes.groupBy("problem_id", "difficulty").agg(
        F.sum("n").alias("n_samples"), F.sum("solved").alias("n_solve"),
        (F.sum("solved") / F.sum("n")).alias("pass1"), F.max((F.col("solved") > 0).cast("bigint")).alias("passk"),
        F.min_by("first_solved", "first").alias("greedy"),
        F.max_by("best_solved", "best").alias("verifier"),
        F.max_by("first_solved", F.struct(F.col("n"), -F.col("first"))).alias("majority"))


def reachability(problems: DataFrame) -> DataFrame:
    """Greedy failures that some sample solves, by difficulty."""
    return problems.where("greedy = 0").groupBy("difficulty").agg(
        F.count(F.lit(1)).alias("greedy_failures"), F.sum("passk").alias("reachable"))


def is_mixed(problems: DataFrame) -> DataFrame:
    return problems.where("n_solve > 0 AND n_solve < n_samples")


def report(samples: DataFrame) -> DataFrame:
    """Solve rates of the ways to choose, on problems with solved and unsolved samples.

    Problems whose greedy sample fails are the held-out part.
    """
    mixed = is_mixed(per_problem(samples))
    part = F.explode(F.array(F.lit("all"), F.when(F.col("greedy") == 0, "held_out").otherwise("train")))
    rates = mixed.withColumn("part", part).groupBy("part").agg(
        F.count(F.lit(1)).alias("n_problems"), F.avg("pass1").alias("random"), F.avg("majority").alias("self_consistency"),
        F.avg("verifier").alias("verification"), F.avg("passk").alias("oracle"))
    auc = roc_auc(samples.join(mixed.select("problem_id"), "problem_id", "left_semi"), "score", "solved")
    return attach(rates, auc.select(F.col("auc").alias("verifier_auc")))


def separation(samples: DataFrame) -> DataFrame:
    """Mean verifier score of correct and incorrect samples of each mixed problem."""
    def mean(flag: int):
        return F.avg(F.when(F.col("solved") == flag, F.col("score")))

    return samples.groupBy("problem_id").agg(mean(1).alias("correct_score"), mean(0).alias("incorrect_score")).where(
        "correct_score IS NOT NULL AND incorrect_score IS NOT NULL")


def separation_auc(samples: DataFrame) -> DataFrame:
    """Verifier AUC over mixed problems: all, and those whose greedy sample fails."""
    mixed = is_mixed(per_problem(samples)).select("problem_id", "greedy")
    part = F.filter(F.array(F.lit("all"), F.when(F.col("greedy") == 0, "held_out")), lambda p: p.isNotNull())
    rows = samples.join(mixed, "problem_id").withColumn("part", F.explode(part))
    return roc_auc(rows, "score", "solved", ["part"])


def calibration(samples: DataFrame) -> DataFrame:
    """Solve rate and number of mixed problems by difficulty."""
    p = samples.groupBy("difficulty", "problem_id").agg(F.sum("solved").alias("s"), F.count(F.lit(1)).alias("n"))
    return p.groupBy("difficulty").agg(
        (F.sum("s") / F.sum("n")).alias("solve_rate"), F.count(F.lit(1)).alias("n_problems"),
        F.count(F.when((F.col("s") > 0) & (F.col("s") < F.col("n")), 1)).alias("n_mixed"))
