"""Samples for human review and the agreement of human and rule-based labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trailcast.functions import text as T
from trailcast.operators.aggregates import frequency
from trailcast.operators.sampling import deduplicated, one_per_run, top_by_risk
from trailcast.operators.scan import RunScan, recent_list

# Coarse families of the failure modes.
MODE_FAMILIES = {
    "looping": "repetition", "patch_churn": "repetition",
    "insufficient_context": "context", "wrong_file": "context",
    "test_neglect": "premature", "submission_too_early": "premature",
    "environment_distraction": "environment", "not_observable": "not_observable",
}


def quadrant(df: DataFrame, kind: str, threshold: float) -> DataFrame:
    """Prefixes of one alarm quadrant, or all of them for ``high_risk``."""
    alarm, failed = F.col("risk") >= threshold, F.col("y_fail") == 1
    tests = {"true_positive": alarm & failed, "false_positive": alarm & ~failed,
             "false_negative": ~alarm & failed, "true_negative": ~alarm & ~failed, "high_risk": F.lit(True)}
    return df.where(tests[kind])


def recent_context(steps: DataFrame, scan: RunScan) -> DataFrame:
    """Last five actions and last three observations at every step, shortened."""
    action = F.concat(F.lit("("), F.col("action_type"), F.lit(") "), T.head(T.strip(F.col("action_text")), 80))
    obs = T.head(F.replace(T.strip(F.col("observation_text")), F.lit("\n"), F.lit(" ")), 120)
    s = scan.apply(steps.select("trajectory_id", "step_index", action.alias("a"), obs.alias("o")),
                   last_actions=recent_list(F.col("a"), 5), last_observations=recent_list(F.col("o"), 3))
    return s.select("trajectory_id", (F.col("step_index") + 1).alias("prefix_step"), "last_actions", "last_observations")


def quadrant_sample(df: DataFrame, kind: str, threshold: float, n: int, context: DataFrame) -> DataFrame:
    """The ``n`` riskiest prefixes of a quadrant with their recent context."""
    return top_by_risk(quadrant(df, kind, threshold), n).join(context, ["trajectory_id", "prefix_step"], "left")


def ending_loops(samples: DataFrame, n: int) -> DataFrame:
    """Samples whose last two actions are the same command."""
    def bare(c: Column) -> Column:
        return T.strip(F.regexp_replace(c, r"^\(\w+\)\s*", ""))

    last, before = (bare(F.try_element_at("last_actions", F.lit(i))) for i in (-1, -2))
    return samples.where((last == before) & (F.length(last) > 3)).orderBy("prefix_id").limit(n).select(
        "prefix_id", last.alias("command"))


def blind_rendering(steps: DataFrame, scan: RunScan, recent: int = 12) -> DataFrame:
    """(trajectory_id, prefix_step, rendered): first observation plus the last steps."""
    action = T.or_empty(T.clip(F.col("action_text"), 160), F.lit("(no action text)"))
    obs = T.clip(F.col("observation_text"), 240)
    line = F.concat(F.lit("["), F.col("step_index").cast("string"), F.lit("] ("), F.col("action_type"), F.lit(") $ "), action,
                    F.when(obs != "", F.concat(F.lit("\n      -> "), obs)).otherwise(F.lit("")))
    goals = steps.where("step_index = 0").select(
        "trajectory_id", T.clip(F.col("observation_text"), 600).alias("goal"))
    s = scan.apply(steps.select("trajectory_id", "step_index", line.alias("line")), lines=recent_list(F.col("line"), recent))
    return s.join(goals, "trajectory_id").select(
        "trajectory_id", (F.col("step_index") + 1).alias("prefix_step"),
        F.concat(F.lit("TASK/CONTEXT (step 0 obs): "), F.col("goal"), F.lit("\n--- recent steps ---\n"),
                 F.array_join("lines", "\n")).alias("rendered"))


def blind_sample(df: DataFrame, threshold: float, n_flagged: int = 40, n_missed: int = 10, seed: int = 7) -> DataFrame:
    """Flagged and missed failures, one per run and instance, in an order that hides the kind."""
    failed = df.where(F.col("y_fail") == 1)

    def pick(rows: DataFrame, by: list[Column], n: int, kind: str) -> DataFrame:
        one = one_per_run(rows, by)
        each = deduplicated(one, "instance_id", [F.col("trajectory_id")])
        return each.orderBy(T.hash_key(F.lit(seed), F.col("prefix_id")), "prefix_id").limit(n).withColumn("kind", F.lit(kind))

    flagged = pick(failed.where(F.col("risk") >= threshold), [F.col("risk"), F.col("prefix_step")], n_flagged, "flagged_failure")
    missed = pick(failed.where(F.col("risk") < threshold), [F.col("prefix_step")], n_missed, "missed_failure")
    # At most n_flagged + n_missed rows are left, so one window may number them.
    w = Window.partitionBy(F.lit(0)).orderBy(T.hash_key(F.lit(seed + 1), F.col("prefix_id")), "prefix_id")
    return flagged.unionByName(missed).withColumn("id", F.format_string("A%02d", F.row_number().over(w) - 1))


def family(mode: Column) -> Column:
    pairs = [F.lit(x) for kv in MODE_FAMILIES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), mode)


def agreement(key: DataFrame, labels: DataFrame) -> DataFrame:
    """Exact and coarse agreement, looping precision and recall; all and by kind."""
    r = key.join(labels, "id").withColumns({
        "agree": (F.col("human_mode") == F.col("heuristic_failure_mode")).cast("bigint"),
        "coarse": F.coalesce(family(F.col("human_mode")).eqNullSafe(
            family(F.col("heuristic_failure_mode"))), F.lit(False)).cast("bigint"),
        "loop_rule": (F.col("heuristic_failure_mode") == "looping").cast("bigint"),
        "loop_human": (F.col("human_mode") == "looping").cast("bigint"),
        "rep_rule": F.col("heuristic_failure_mode").isin("looping", "patch_churn").cast("bigint"),
        "rep_human": F.col("human_mode").isin("looping", "patch_churn").cast("bigint"),
        "unseen": F.col("human_mode").isin("not_observable", "insufficient_context").cast("bigint")})
    both = r.withColumn("group", F.explode(F.array(F.col("kind"), F.lit("all"))))
    tp = F.sum(F.col("loop_rule") * F.col("loop_human"))
    one = F.lit(1)
    return both.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), F.avg("agree").alias("exact_agreement"), F.avg("coarse").alias("coarse_agreement"),
        F.avg("loop_rule").alias("looping_rule"), F.avg("loop_human").alias("looping_human"),
        F.avg("rep_rule").alias("repetition_rule"), F.avg("rep_human").alias("repetition_human"),
        (tp / F.greatest(one, F.sum("loop_rule"))).alias("looping_precision"),
        (tp / F.greatest(one, F.sum("loop_human"))).alias("looping_recall"),
        F.avg("unseen").alias("not_observable_human"))


def mode_distribution(key: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of every mode by kind and by who assigned it."""
    r = key.join(labels, "id").select("kind", F.explode(F.array(
        F.struct(F.lit("human").alias("source"), F.col("human_mode").alias("mode")),
        F.struct(F.lit("rule").alias("source"), F.col("heuristic_failure_mode").alias("mode")))).alias("x"))
    return frequency(r.select("kind", "x.source", "x.mode"), "mode", ["kind", "source"])
