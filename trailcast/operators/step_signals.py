"""Per-step signals read from the text of one step. A map without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trailcast.functions import patterns as P
from trailcast.functions import text as T


def with_defaults(steps: DataFrame) -> DataFrame:
    """Add the optional step columns that are missing."""
    missing = {"thought_text": F.lit(""), "returncode": F.lit(None).cast("bigint")}
    return steps.withColumns({c: v for c, v in missing.items() if c not in steps.columns})


def classify(steps: DataFrame) -> DataFrame:
    """Action family, independent family flags, command and paths of every step."""
    action = F.coalesce(F.col("action_text"), F.lit(""))
    flagged = steps.withColumns({f"_is_{f}": T.family_match(action, f) for f in P.FAMILIES})
    hits = {f: F.col(f"_is_{f}") for f in P.FAMILIES}
    return flagged.withColumns({
        "action_type": T.action_type(action, hits),
        "command": T.first_command(action),
        "file_paths": T.file_paths(action),
        **{f"is_{f}_command": hits[f] for f in P.FLAGGED},
    }).drop(*[f"_is_{f}" for f in P.FAMILIES])


def read_results(steps: DataFrame) -> DataFrame:
    """Test counts and error flags found in the observation."""
    passed, failed = T.test_counts(F.col("observation_text"))
    return steps.withColumns({
        "test_pass_count": passed,
        "test_fail_count": failed,
        "contains_traceback": T.has_traceback(F.col("observation_text")),
        "contains_exception": T.has_exception(F.col("observation_text")),
    })


def step_signals(steps: DataFrame, errors: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Slim numeric row per step: what the feature windows need, without the long texts.

    ``keep`` names further columns that go along, such as the time of a stream.
    """
    s = read_results(classify(with_defaults(steps)))
    action, obs = T.or_empty(F.col("action_text")), T.or_empty(F.col("observation_text"))
    is_error = F.col("contains_traceback") | F.col("contains_exception")
    bad_test = (F.coalesce(F.col("test_fail_count"), F.lit(0)) > 0) | is_error
    clean_obs = T.strip(obs)
    first_line = T.head(F.get(F.split(clean_obs, P.LINE_END), F.lit(0)), 120)
    kind = F.col("action_type")
    columns = {
        "k": F.col("step_index") + 1,
        "kind": kind,
        "files": F.col("file_paths"),
        "cmd": T.normalized_command(F.col("command"), action, 200),
        "shown_cmd": T.strip(T.or_empty(F.col("command"), F.col("action_text"))),
        "is_test": F.col("is_test_command"),
        "has_action": (T.strip(action) != "").cast("bigint"),
        "thought_len": F.length(T.or_empty(F.col("thought_text"))).cast("bigint"),
        "action_len": F.length(action).cast("bigint"),
        "obs_len": F.length(obs).cast("bigint"),
        "passes": F.when(F.col("is_test_command"), F.col("test_pass_count")),
        "fails": F.when(F.col("is_test_command"), F.col("test_fail_count")),
        "test_code": F.when(
            F.col("is_test_command"),
            F.coalesce(F.col("returncode").cast("bigint"), bad_test.cast("bigint"))),
        "traceback": F.col("contains_traceback").cast("bigint"),
        "exception": F.col("contains_exception").cast("bigint"),
        "assertion": T.matches(obs, P.ASSERTION).cast("bigint"),
        "is_err": is_error.cast("bigint"),
        "obs_key": F.when(clean_obs != "", F.md5(T.head(clean_obs, 500))),
        "err_line": F.when(is_error & (first_line != ""), F.md5(first_line)),
        "raw_returncode": F.col("returncode").cast("bigint"),
    }
    if errors:
        columns.update({f"err_{n}": c for n, c in T.error_counts(obs).items()})
    return s.select("trajectory_id", "instance_id", "model_name", "step_index", *(keep or []),
                    *[c.alias(n) for n, c in columns.items()])
