"""Label shaping, rule scores and the failure-mode taxonomy over prefix features."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from trailcast.operators.ordering import attach, running_total
from trailcast.operators.sampling import shuffled
from trailcast.operators.scan import RunScan, running_sum

# Rules over prefix features. A rule holds when any of its lines does.
TROUBLE = [
    "max_command_repeat_count >= 3",
    "same_action_type_streak >= 5",
    "repeated_exact_command_last_3 > 0",
    "n_test_runs >= 2 and tests_worsening > 0",
    "n_test_runs >= 2 and last_test_fail_count > 0",
    "n_tracebacks_seen >= 2",
    "edited_file_never_read_count >= 1 and n_edit >= 2",
]
# Drift rules, of which the share that holds is the score.
DRIFT = [
    "edited_before_any_read > 0",
    "repeated_exact_command_last_3 > 0",
    "patch_growth_without_test_improvement > 0",
    "n_test_runs >= 2 and tests_worsening > 0",
    "edited_file_never_read_count > 0",
]
# Rules of the failure modes; the first mode whose rule holds is given.
MODE_RULES = {
    "looping": ["max_command_repeat_count >= 3", "repeated_exact_command_last_3 > 0", "same_action_type_streak >= 5"],
    "patch_churn": ["tests_worsening > 0", "same_test_command_repeated >= 2"],
    "insufficient_context": ["edited_before_any_read > 0", "edited_file_never_read_count > 0"],
    "test_neglect": ["n_edit > 0 and n_test_runs = 0"],
    "submission_too_early": ["n_submit > 0 and n_edit = 0"],
    "environment_distraction": ["n_install >= 2", "n_environment >= n_edit + n_read + 1"],
    "wrong_file": ["n_unique_files_edited >= 1 and n_unique_files_read = 0"],
}
NO_MODE = "not_observable"
# Names of the modes.
FAILURE_MODES = [
    "insufficient_context", "wrong_file", "test_neglect", "looping",
    "patch_churn", "environment_distraction", "submission_too_early", "not_observable",
]
_COMPARE = {">": operator.gt, ">=": operator.ge, "=": operator.eq}


def feature(df: DataFrame, name: str, default: float = 0.0) -> Column:
    """Numeric feature with or without the prefix; missing or unreadable values become the default."""
    types = dict(df.dtypes)
    for c in (f"f__{name}", name):
        if c in types:
            col = F.col(c).cast("int") if types[c] == "boolean" else F.col(c)
            number = col.try_cast("double")
            return F.coalesce(F.when(~F.isnan(number), number), F.lit(default))
    return F.lit(float(default))


def to_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as doubles with 0 for anything that is not a number."""
    return df.withColumns({c: feature(df, c) for c in columns})


def _conditions(line: str) -> list[tuple[str, str, list[str]]]:
    """(feature, comparison, summands of the bound) of each condition of a rule line."""
    parts = [c.split(None, 2) for c in line.split(" and ")]
    return [(name, compare, bound.split(" + ")) for name, compare, bound in parts]


def holds(df: DataFrame, rule: list[str]) -> Column:
    """Whether any line of a rule holds; features that are missing are 0."""
    def term(x: str) -> Column:
        return F.lit(float(x)) if x.isdigit() else feature(df, x)

    lines = [reduce(operator.and_, [
        _COMPARE[compare](feature(df, name), reduce(operator.add, map(term, bound)))
        for name, compare, bound in _conditions(line)]) for line in rule]
    return reduce(operator.or_, lines)


def trouble(df: DataFrame) -> Column:
    """Whether the prefix visibly is in trouble."""
    return holds(df, TROUBLE)


def shaped_labels(df: DataFrame, low: float = 0.3) -> DataFrame:
    """Trouble flag, trouble-gated label and down-weights for failures without trouble."""
    t, failed = trouble(df), F.col("y_fail") == 1
    return df.withColumns({
        "trouble": t.cast("bigint"),
        "y_gated": (failed & t).cast("bigint"),
        "w_noisy": F.when(failed & ~t, low).otherwise(1.0),
    })


def position_weights(df: DataFrame) -> DataFrame:
    """Training weights that grow with the position in the run."""
    part = F.col("prefix_step") / F.greatest(F.lit(1).cast("bigint"), F.col("n_total_steps"))
    floor = F.lit(1e-3)
    return df.withColumns({
        "w_linear": F.greatest(floor, part), "w_quadratic": F.greatest(floor, part * part),
        "w_late": F.greatest(floor, part + 0.3)})


def trouble_onset(df: DataFrame) -> DataFrame:
    """First prefix of each run with visible trouble; NULL when there is none."""
    return df.groupBy("trajectory_id").agg(
        F.max("n_total_steps").alias("n_total_steps"), F.max("y_fail").alias("y_fail"),
        F.min(F.when(trouble(df), F.col("prefix_step"))).alias("onset_step"))


def life_table(onset: DataFrame) -> DataFrame:
    """Runs at risk and onsets by step, with the survival-style risk 1 − Π(1 − h)."""
    exits = onset.select(
        F.coalesce("onset_step", "n_total_steps").alias("step"),
        F.col("onset_step").isNotNull().cast("bigint").alias("event"))
    h = exits.groupBy("step").agg(F.count(F.lit(1)).alias("exits"), F.sum("event").alias("events"))
    total = h.agg(F.sum("exits").alias("total"))
    bucket = F.floor(F.col("step") / 256).cast("bigint")
    t = attach(running_total(h, "step", ["exits"], bucket), total).withColumn(
        "at_risk", F.col("total") - F.col("exits_before"))
    t = t.withColumn("hazard", F.col("events") / F.col("at_risk"))
    # ln 0 (everyone left has an onset) is kept apart because it would swallow the sum.
    t = t.withColumns({
        "log_stay": F.when(F.col("events") < F.col("at_risk"), F.ln(1 - F.col("hazard"))).otherwise(0.0),
        "all_gone": (F.col("events") == F.col("at_risk")).cast("bigint")})
    c = running_total(t.select("step", "events", "at_risk", "hazard", "log_stay", "all_gone"), "step",
                      ["log_stay", "all_gone"], bucket)
    gone = F.col("all_gone_before") + F.col("all_gone") > 0
    return c.select("step", "at_risk", "events", "hazard", F.when(gone, 1.0).otherwise(
        1 - F.exp(F.col("log_stay_before") + F.col("log_stay"))).alias("risk"))


def survival_risk(hazards: DataFrame, scan: RunScan) -> DataFrame:
    """Monotone risk of each step from per-step hazards (``hazard``)."""
    safe = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(0.0), F.col("hazard")))
    s = scan.apply(hazards, _log=running_sum(F.ln(1 - safe)))
    return s.withColumn("risk", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), 1 - F.exp("_log")))).drop("_log")


def rule_score(df: DataFrame, skip_missing: bool = False) -> Column:
    """Share of five drift rules that hold.

    Rules whose columns are missing count as false; with ``skip_missing`` they leave
    the denominator instead.
    """
    names = {c.removeprefix("f__") for c in df.columns}
    used = [line for line in DRIFT
            if not skip_missing or names.issuperset(name for name, _, _ in _conditions(line))]
    counted = reduce(operator.add, [holds(df, [line]).cast("int") for line in used], F.lit(0))
    return counted / F.lit(float(max(1, len(used))))


def failure_mode(df: DataFrame) -> Column:
    """First matching mode of the taxonomy."""
    return F.coalesce(*[F.when(holds(df, rule), F.lit(mode)) for mode, rule in MODE_RULES.items()], F.lit(NO_MODE))


def shuffled_labels(df: DataFrame, label: str = "y_fail", key: str = "prefix_id", seed: int = 42) -> DataFrame:
    """The same rows with labels dealt out in random order (``y_shuffled``)."""
    target = shuffled(df, key, seed, "_no")
    source = shuffled(df.select(key, F.col(label).alias("y_shuffled")), key, seed + 1, "_no")
    return target.join(source.select("_no", "y_shuffled"), "_no").drop("_no")
