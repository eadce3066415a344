"""Leakage-safe splits: whole groups go to one fold.

Groups are put in hash order and numbered in two levels, so the number of groups is
not bounded by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trailcast.functions import text as T
from trailcast.operators.ordering import attach, number_rows, text_bucket


def ranked_groups(groups: DataFrame, group: str, seed: int) -> DataFrame:
    """(group, place, total) with groups in hash order, ``place`` from 1."""
    g = groups.select(group).distinct().withColumn("_h", T.hash_key(F.lit(seed), F.col(group)))
    numbered = number_rows(g, [F.col("_h"), F.col(group)], text_bucket(F.col("_h")), "place")
    return attach(numbered, g.agg(F.count(F.lit(1)).alias("total"))).select(group, "place", "total")


def grouped_folds(df: DataFrame, group: str = "instance_id", test_size: float = 0.2, val_size: float = 0.2,
                  seed: int = 42) -> DataFrame:
    """(group, fold): test takes a rounded-up share of the groups, validation one of the rest."""
    r = ranked_groups(df, group, seed)
    n_test = F.ceil(F.col("total") * F.lit(test_size)).cast("bigint")
    n_val = F.ceil((F.col("total") - n_test) * F.lit(val_size)).cast("bigint")
    fold = F.when(F.col("place") <= n_test, "test").when(F.col("place") <= n_test + n_val, "val").otherwise("train")
    return r.select(group, fold.alias("fold"))


def split(df: DataFrame, regime: str = "instance", test_size: float = 0.2, val_size: float = 0.2, seed: int = 42,
          holdout_models: list[str] | None = None) -> DataFrame:
    """``df`` with a ``fold`` column; regimes ``instance``, ``repo`` and ``model``."""
    if regime == "instance":
        return df.join(grouped_folds(df, "instance_id", test_size, val_size, seed), "instance_id")
    if regime == "repo":
        d = df.withColumn("repo", T.repository(F.col("instance_id")))
        return d.join(grouped_folds(d, "repo", test_size, val_size, seed), "repo")
    if regime != "model":
        raise ValueError(f"unknown regime {regime!r}")
    if holdout_models:
        held = df.withColumn("held", F.coalesce(F.col("model_name").isin(holdout_models), F.lit(False)))
    else:
        models = ranked_groups(df.where(F.col("model_name").isNotNull()), "model_name", seed)
        chosen = models.where(F.col("place") <= F.greatest(
            F.lit(1).cast("bigint"), F.floor(F.col("total") / 3))).select("model_name", F.lit(True).alias("held"))
        held = df.join(chosen, "model_name", "left").withColumn("held", F.coalesce("held", F.lit(False)))
    rest = held.where(~F.col("held"))
    inner = ranked_groups(rest, "instance_id", seed)
    folds = inner.select("instance_id", F.when(
        F.col("place") <= F.ceil(F.col("total") * F.lit(val_size)), "val").otherwise("train").alias("fold"))
    return held.where("held").withColumn("fold", F.lit("test")).unionByName(
        rest.join(folds, "instance_id").select(*held.columns, "fold")).drop("held")


def summary(df: DataFrame, group: str = "instance_id") -> DataFrame:
    return df.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(group).alias("n_groups"),
        F.avg(F.col("y_fail").cast("double")).alias("fail_rate"))


def overlap(df: DataFrame, group: str = "instance_id") -> DataFrame:
    """Number of groups that occur in more than one fold (0 for a valid split)."""
    return df.groupBy(group).agg(F.count_distinct("fold").alias("folds")).agg(
        F.count(F.lit(1)).alias("n_groups"), F.count(F.when(F.col("folds") > 1, 1)).alias("n_shared"))


def check_disjoint(df: DataFrame, group: str = "instance_id") -> DataFrame:
    shared = overlap(df, group).first().n_shared
    if shared:
        raise ValueError(f"{shared} values of {group} are in more than one fold")
    return df


def greedy_shares(sizes: list[tuple[int, int]], k: int) -> list[tuple[int, int, int]]:
    """(size, fold, number of groups) when groups go from large to small, each to the lightest fold so far.

    ``sizes`` lists (size, number of groups). Equal sizes are dealt in bulk: folds that differ by less than a
    size take turns until they reach the next heavier one.
    """
    loads, out = [0] * k, []
    for size, left in sorted(sizes, reverse=True):
        given = [0] * k
        while left:
            order = sorted(range(k), key=lambda f: (loads[f], f))
            near = [f for f in order if loads[f] - loads[order[0]] < size]
            turns = left // len(near)
            if len(near) < k:
                turns = min(turns, (loads[order[len(near)]] - loads[near[-1]] - 1) // size)
            taking = near if turns else order[:1]
            for f in taking:
                loads[f] += max(1, turns) * size
                given[f] += max(1, turns)
            left -= max(1, turns) * len(taking)
        out += [(size, f, n) for f, n in enumerate(given) if n]
    return out


def group_kfold(df: DataFrame, group: str = "instance_id", k: int = 5, by: list[str] | None = None,
                seed: int = 0) -> DataFrame:
    """(by, group, fold): groups from large to small, each to the fold with the fewest rows so far.

    Only the number of groups of each size reaches the driver (N rows have less than sqrt(2 N) distinct
    sizes). Groups of one size are interchangeable; they are dealt by hash.
    """
    by = by or []
    sizes = df.groupBy(*by, group).agg(F.count(F.lit(1)).alias("n")).withColumn("_h", T.hash_key(F.lit(seed), F.col(group)))
    found: dict[tuple, list[tuple[int, int]]] = {}
    for r in sizes.groupBy(*by, "n").agg(F.count(F.lit(1)).alias("_c")).collect():
        found.setdefault(tuple(r[: len(by)]), []).append((r["n"], r["_c"]))
    shares = []
    for key, own in found.items():
        last: dict[int, int] = {}
        for size, fold, n in greedy_shares(own, k):
            shares.append((*key, size, fold, last.get(size, 0), last.get(size, 0) + n))
            last[size] = last.get(size, 0) + n
    types = dict(df.dtypes)
    spans = df.sparkSession.createDataFrame(shares, ", ".join(
        [f"`{c}` {types[c]}" for c in by] + ["n bigint", "fold bigint", "_from bigint", "_to bigint"]))
    ranked = number_rows(sizes, [F.col("_h"), F.col(group)], text_bucket(F.col("_h")), "place", [*by, "n"])
    return ranked.join(spans, [*by, "n"]).where("place > _from and place <= _to").select(*by, group, "fold")


def transfer_roles(df: DataFrame, source_model: str, seed: int = 42, train_share: float = 0.85) -> DataFrame:
    """Roles for a cross-model study: rows of other models are ``target``; the source model
    keeps only instances the others never saw, split into ``train`` and ``holdout``."""
    target = df.where(F.col("model_name") != source_model)
    pool = df.where(F.col("model_name") == source_model).join(
        target.select("instance_id").distinct(), "instance_id", "left_anti")
    r = ranked_groups(pool, "instance_id", seed)
    roles = r.select("instance_id", F.when(
        F.col("place") <= F.floor(F.col("total") * F.lit(train_share)), "train").otherwise("holdout").alias("role"))
    return pool.join(roles, "instance_id").select(*df.columns, "role").unionByName(
        target.withColumn("role", F.lit("target")))
