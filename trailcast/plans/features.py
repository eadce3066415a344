"""Queries over steps and prefixes: classification, schedules and features.

The SQL twins rebuild every prefix by joining each step with all steps up to it,
which is the definition; the Spark side uses running windows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trailcast.functions import patterns as P
from trailcast.operators import features as FT
from trailcast.functions import text as T
from trailcast.operators import prefixes as PX
from trailcast.operators.scan import by_run_length
from trailcast.plans.registry import query
from trailcast.sources import standin as S


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_FLAGS = ",\n    ".join(
    f"regexp_matches(action_text, {quoted(rx)}) AS m_{name}" for name, rx in P.FAMILIES.items())
_KIND = "CASE WHEN trim(action_text) = '' THEN 'unknown' " + " ".join(
    f"WHEN m_{n} THEN '{n}'" for n in P.FAMILIES) + " ELSE 'other' END"
_SUM = "coalesce(list_sum(list_transform(regexp_extract_all(observation_text, '(?i){0}', 1), lambda x: CAST(x AS BIGINT))), 0)"
_HAS = f"regexp_matches(observation_text, {quoted('(?i)' + P.N_PASSED + '|' + P.N_FAILED + '|' + P.N_ERRORS)})"

CLASSIFIED = S.SQL["steps"] + f""",
flagged AS (SELECT *, {_FLAGS} FROM steps),
classified AS (
  SELECT *, {_KIND} AS kind, m_test AS is_test,
    left(regexp_replace(trim(action_text), '\\s+', ' ', 'g'), 200) AS cmd,
    list_distinct(regexp_extract_all(action_text, {quoted(P.FILE_PATH)}, 1)) AS files,
    CASE WHEN {_HAS} THEN {_SUM.format(P.N_PASSED)} END AS passed,
    CASE WHEN {_HAS} THEN {_SUM.format(P.N_FAILED)} + {_SUM.format(P.N_ERRORS)} END AS failed,
    CAST(regexp_matches(observation_text, {quoted(P.TRACEBACK)}) AS BIGINT) AS traceback,
    CAST(regexp_matches(observation_text, {quoted(P.EXCEPTION)}) AS BIGINT) AS exception
  FROM flagged)"""


@query("step_classification", "WITH " + CLASSIFIED + """
SELECT trajectory_id, step_index, kind AS action_type, action_text AS command, len(files) AS n_files,
  CAST(m_test AS BIGINT) AS is_test, CAST(m_search AS BIGINT) AS is_search, CAST(m_read AS BIGINT) AS is_read,
  CAST(m_edit AS BIGINT) AS is_edit, CAST(m_git AS BIGINT) AS is_git, CAST(m_install AS BIGINT) AS is_install,
  CAST(m_submit AS BIGINT) AS is_submit, passed, failed, traceback, exception
FROM classified""")
def step_classification(spark, sf):
    from trailcast.operators.step_signals import classify, read_results

    s = read_results(classify(S.steps(spark, sf)))
    return s.select(
        "trajectory_id", "step_index", "action_type", "command",
        F.size("file_paths").cast("bigint").alias("n_files"),
        *[F.col(f"is_{f}_command").cast("bigint").alias(f"is_{f}") for f in P.FLAGGED],
        F.col("test_pass_count").alias("passed"), F.col("test_fail_count").alias("failed"),
        F.col("contains_traceback").cast("bigint").alias("traceback"),
        F.col("contains_exception").cast("bigint").alias("exception"))


_PREFIX_ROWS = CLASSIFIED + f""",
heads AS (
  SELECT c.trajectory_id, c.instance_id, c.model_name, c.step_index, c.step_no AS n, r.n_total_steps, r.y_fail
  FROM classified c JOIN runs r USING (trajectory_id) WHERE {S.ON_SCHEDULE_SQL}),
pre AS (
  SELECT h.n, s.* FROM heads h JOIN classified s ON s.trajectory_id = h.trajectory_id AND s.step_no <= h.n),
meta AS (
  SELECT substr(sha1(concat(trajectory_id, chr(31), n)), 1, 12) AS prefix_id, trajectory_id, instance_id,
    model_name, n AS prefix_step, n_total_steps, y_fail FROM heads)"""


@query("prefix_schedule", "WITH " + _PREFIX_ROWS + " SELECT * FROM meta")
def prefix_schedule(spark, sf):
    e = S.event_log(spark, sf)
    rows = e.select("trajectory_id", "instance_id", "model_name",
                    (F.col("step_index") + 1).alias("prefix_step"))
    return PX.label_prefixes(rows, S.runs(e)).select(*PX.META)


@query("prefix_schedule_sizes", "WITH " + S.SQL["events"] + """,
s AS (SELECT step_index + 1 AS k, n_total_steps AS n FROM events_n JOIN runs USING (trajectory_id))
SELECT 'dense' AS mode, count(*) AS n_prefixes, CAST(sum(k) AS BIGINT) AS steps FROM s
  WHERE k <= 60 OR (k >= 60 AND (k - 60) % 5 = 0) OR k = n
UNION ALL SELECT 'sparse', count(*), CAST(sum(k) AS BIGINT) FROM s WHERE k IN (1, 3, 5) OR k % 10 = 0 OR k = n
UNION ALL SELECT 'default', count(*), CAST(sum(k) AS BIGINT) FROM s WHERE k <= 5 OR (k >= 10 AND k % 5 = 0) OR k = n""")
def prefix_schedule_sizes(spark, sf):
    e = S.event_log(spark, sf)
    rows = e.select("trajectory_id", (F.col("step_index") + 1).alias("k")).join(
        S.runs(e).select("trajectory_id", F.col("n_total_steps").alias("n")), "trajectory_id")
    modes = F.filter(F.array(*[
        F.when(PX.on_schedule(F.col("k"), F.col("n"), m), F.lit(m)) for m in ("default", "dense", "sparse")]),
        lambda m: m.isNotNull())
    return rows.select("k", F.explode(modes).alias("mode")).groupBy("mode").agg(
        F.count(F.lit(1)).alias("n_prefixes"), F.sum("k").alias("steps"))


def _count(kind: str) -> str:
    return f"count(*) FILTER (kind = '{kind}')"


_BASE_SQL = _PREFIX_ROWS + """,
lagged AS (
  SELECT p.*, lag(kind) OVER w AS kind_before FROM pre p
  WINDOW w AS (PARTITION BY trajectory_id, n ORDER BY step_no)),
first_edit AS (
  SELECT trajectory_id, n, min(step_no) FILTER (kind = 'edit') AS fe FROM pre GROUP BY ALL),
counts AS (
  SELECT trajectory_id, n, count(*) FILTER (trim(action_text) <> '') AS n_actions_seen,
    CAST(sum((length(thought_text) + length(action_text)) // 4) AS BIGINT) AS n_model_tokens_approx,
    CAST(sum(length(observation_text)) AS BIGINT) AS n_observation_chars,
    """ + ", ".join(f"{_count(t)} AS n_{t}" for t in P.ACTION_TYPES) + """,
    coalesce(any_value(fe), -1) AS first_edit_step,
    count(*) FILTER (kind = 'read' AND step_no < coalesce(fe, 1e9)) AS n_reads_before_first_edit,
    count(*) FILTER (kind = 'search' AND step_no < coalesce(fe, 1e9)) AS n_searches_before_first_edit,
    CAST(any_value(fe) IS NOT NULL AND count(*) FILTER (kind = 'read' AND step_no < fe) = 0 AS BIGINT) AS edited_before_any_read,
    CAST(any_value(fe) IS NOT NULL AND count(*) FILTER (kind = 'search' AND step_no < fe) = 0 AS BIGINT) AS edited_before_any_search,
    count(*) FILTER (is_test) AS n_test_runs,
    count(*) FILTER (is_test) - count(DISTINCT cmd) FILTER (is_test) AS same_test_command_repeated,
    coalesce(arg_max(CAST(failed > 0 OR traceback = 1 OR exception = 1 AS BIGINT), step_no) FILTER (is_test), -1) AS last_test_returncode,
    list(failed ORDER BY step_no) FILTER (is_test AND failed IS NOT NULL) AS fails,
    coalesce(arg_max(passed, step_no) FILTER (is_test AND passed IS NOT NULL), -1) AS last_test_pass_count,
    CAST(sum(traceback) AS BIGINT) AS n_tracebacks_seen,
    count(*) FILTER (contains(observation_text, 'AssertionError')) AS n_assertion_errors_seen,
    CAST(count(*) FILTER (step_no > n - 3) > count(DISTINCT cmd) FILTER (step_no > n - 3) AS BIGINT) AS repeated_exact_command_last_3,
    CAST(count(*) FILTER (step_no > n - 5) > count(DISTINCT cmd) FILTER (step_no > n - 5) AS BIGINT) AS repeated_exact_command_last_5,
    n - coalesce(max(step_no) FILTER (kind <> last_kind), 0) AS same_action_type_streak,
    count(*) FILTER (kind = 'test' AND kind_before = 'edit') AS edit_test_edit_test_loop_count
  FROM lagged JOIN first_edit USING (trajectory_id, n)
    JOIN (SELECT trajectory_id, step_no AS n, kind AS last_kind FROM classified) USING (trajectory_id, n)
  GROUP BY trajectory_id, n),
cmd_max AS (
  SELECT trajectory_id, n, max(c) AS max_command_repeat_count
  FROM (SELECT trajectory_id, n, cmd, count(*) AS c FROM pre GROUP BY ALL) GROUP BY ALL),
per_file AS (
  SELECT trajectory_id, n, file, count(*) FILTER (kind = 'edit') AS edits, count(*) FILTER (kind = 'read') AS reads
  FROM (SELECT trajectory_id, n, kind, unnest(files) AS file FROM pre) GROUP BY ALL),
file_counts AS (
  SELECT trajectory_id, n, count(*) AS n_unique_files_seen, count(*) FILTER (reads > 0) AS n_unique_files_read,
    count(*) FILTER (edits > 0) AS n_unique_files_edited,
    count(DISTINCT regexp_replace(CASE WHEN contains(file, '/') THEN file ELSE '/' END, '/[^/]*$', '')) FILTER (edits > 0) AS n_unique_dirs_edited,
    count(*) FILTER (file LIKE 'tests/%') AS n_test_files_touched,
    count(*) FILTER (file NOT LIKE 'tests/%') AS n_src_files_touched,
    count(*) FILTER (edits > 0 AND reads = 0) AS edited_file_never_read_count,
    max(edits) AS same_file_edit_count_max, max(reads) AS read_same_file_repeatedly
  FROM per_file GROUP BY ALL),
base AS (
  SELECT m.prefix_id, m.trajectory_id, m.instance_id, m.model_name, m.prefix_step, m.n_total_steps, m.y_fail,
    c.* EXCLUDE (trajectory_id, n, fails),
    n_observation_chars / c.n AS avg_observation_chars,
    n_edit / greatest(1, n_read) AS edit_to_read_ratio, n_test / greatest(1, n_edit) AS test_to_edit_ratio,
    n_search / greatest(1, n_edit) AS search_to_edit_ratio,
    coalesce(fails[-1], -1) AS last_test_fail_count, fails,
    CASE WHEN len(fails) >= 2 THEN fails[-1] - fails[-2] ELSE 0 END AS test_fail_count_delta,
    max_command_repeat_count,
    """ + ", ".join(f"coalesce({c}, 0) AS {c}" for c in [
        "n_unique_files_seen", "n_unique_files_read", "n_unique_files_edited", "n_unique_dirs_edited",
        "n_test_files_touched", "n_src_files_touched", "edited_file_never_read_count",
        "same_file_edit_count_max", "read_same_file_repeatedly"]) + """
  FROM meta m JOIN counts c ON c.trajectory_id = m.trajectory_id AND c.n = m.prefix_step
    JOIN cmd_max x ON x.trajectory_id = c.trajectory_id AND x.n = c.n
    LEFT JOIN file_counts f ON f.trajectory_id = c.trajectory_id AND f.n = c.n),
base_flags AS (
  SELECT *, CAST(test_fail_count_delta < 0 AS BIGINT) AS tests_improving,
    CAST(test_fail_count_delta > 0 AS BIGINT) AS tests_worsening FROM base)"""
_RATIOS = {"avg_observation_chars", "edit_to_read_ratio", "test_to_edit_ratio", "search_to_edit_ratio"}


def base_output_sql(names: list[str]) -> str:
    return ", ".join(
        ("prefix_step" if n == "prefix_step" else
         f"round({n}, 6)" if n in _RATIOS else f"CAST({n} AS BIGINT)") + f" AS f__{n}" for n in names)


BASE_SQL = _BASE_SQL


def rounded(df, doubles=None):
    return df.select(*[
        F.round(c, 6).alias(c) if t == "double" and (doubles is None or c in doubles) else F.col(c)
        for c, t in df.dtypes])


@query("prefix_features_base", "WITH " + _BASE_SQL + f"""
SELECT {", ".join(PX.META)}, {base_output_sql(FT.BASE_FEATURES)} FROM base_flags""")
def prefix_features_base(spark, sf):
    steps = S.steps(spark, sf)
    return rounded(FT.prefix_table(steps, S.runs(steps)))


def _recent(expression: str, w: int) -> str:
    return expression.replace("*W*", f"step_no > n - {w}")


def _width(w: int) -> str:
    return f"least({w}, n)"


_WINDOW_SQL = ", ".join(
    _recent(f"""count(*) FILTER (kind = 'edit' AND *W*) AS adv_w{w}_n_edit,
    count(*) FILTER (kind = 'test' AND *W*) AS adv_w{w}_n_test,
    count(*) FILTER (kind = 'edit' AND *W*) / {_width(w)} AS adv_w{w}_edit_frac,
    count(*) FILTER (kind = 'test' AND *W*) / {_width(w)} AS adv_w{w}_test_frac,
    count(DISTINCT cmd) FILTER (*W*) AS adv_w{w}_distinct_cmd,
    1.0 - count(DISTINCT cmd) FILTER (*W*) / {_width(w)} AS adv_w{w}_repeat_ratio,
    count(*) FILTER (is_err AND *W*) / {_width(w)} AS adv_w{w}_err_frac,
    sum(CASE WHEN *W* THEN length(observation_text) ELSE 0 END) / {_width(w)} AS adv_w{w}_obs_mean""", w)
    for w in (5, 10))
_ERROR_SQL = ", ".join(
    f"CAST(sum(CASE WHEN step_no > n - 12 THEN len(regexp_extract_all(left(observation_text, 1500), {quoted(rx)})) ELSE 0 END) AS BIGINT) AS adv_err_{name}"
    for name, rx in P.ERROR_CATEGORIES.items())


def _since(condition: str) -> str:
    return f"n - coalesce(max(step_no) FILTER ({condition}), 0)"


_DYNAMICS_SQL = _BASE_SQL + f""",
first_read AS (
  SELECT trajectory_id, file, min(step_no) AS step_no
  FROM (SELECT trajectory_id, step_no, unnest(files) AS file FROM classified WHERE kind = 'read') GROUP BY ALL),
tests AS (
  SELECT trajectory_id, step_no, failed, lag(failed) OVER w AS prev, row_number() OVER w AS t
  FROM classified WHERE is_test AND failed IS NOT NULL
  WINDOW w AS (PARTITION BY trajectory_id ORDER BY step_no)),
islands AS (
  SELECT *, step_no - row_number() OVER (PARTITION BY trajectory_id, kind ORDER BY step_no) AS island FROM classified),
marked AS (
  SELECT i.*, traceback = 1 OR exception = 1 AS is_err,
    (i.trajectory_id, i.step_no) IN (SELECT (trajectory_id, step_no) FROM first_read) AS new_read,
    t.t, t.prev IS NULL OR t.failed < t.prev AS report_improves, t.failed < t.prev AS improved,
    row_number() OVER (PARTITION BY i.trajectory_id, kind, island ORDER BY i.step_no) AS streak,
    lag(kind) OVER w AS kind_1, lag(cmd) OVER w AS cmd_1, lag(cmd, 2) OVER w AS cmd_2
  FROM islands i LEFT JOIN tests t ON t.trajectory_id = i.trajectory_id AND t.step_no = i.step_no
  WINDOW w AS (PARTITION BY i.trajectory_id ORDER BY i.step_no)),
mpre AS (
  SELECT h.n, s.* FROM heads h JOIN marked s ON s.trajectory_id = h.trajectory_id AND s.step_no <= h.n),
prog AS (
  SELECT trajectory_id, n, coalesce(max(step_no) FILTER (new_read OR coalesce(improved, false)), 0) AS last_prog,
    bool_or(is_err AND step_no = n) AS err_now FROM mpre GROUP BY ALL),
dyn AS (
  SELECT trajectory_id, n, {_WINDOW_SQL}, {_ERROR_SQL},
    {_since("kind = 'test'")} AS adv_ts_test, {_since("kind = 'edit'")} AS adv_ts_edit,
    {_since("kind = 'search'")} AS adv_ts_search, {_since("is_err")} AS adv_ts_error,
    {_since("new_read")} AS adv_ts_new_file, n - max(last_prog) AS adv_ts_progress,
    count(kind_1) - count(DISTINCT concat(kind_1, '>', kind)) FILTER (kind_1 IS NOT NULL) AS adv_seq_bigram_repeat,
    count(cmd_2) - count(DISTINCT concat(cmd_2, '>', cmd_1, '>', cmd)) FILTER (cmd_2 IS NOT NULL) AS adv_seq_trigram_repeat,
    max(streak) AS adv_seq_longest_run,
    coalesce(avg(1 - levenshtein(cmd_1, cmd) / greatest(length(cmd_1), length(cmd))) FILTER (step_no > n - 8), 0.0) AS adv_seq_consec_cmd_sim,
    count(*) FILTER (observation_text <> '' AND step_no > n - 8)
      - count(DISTINCT observation_text) FILTER (observation_text <> '' AND step_no > n - 8) AS adv_seq_obs_repeat_recent,
    CASE WHEN bool_or(err_now) THEN {_since("NOT is_err")} ELSE 0 END AS adv_err_streak,
    count(*) FILTER (is_err AND step_no > n - 5) AS adv_err_recent_total,
    count(*) FILTER (is_err) / n AS adv_err_rate,
    CAST(count(*) FILTER (kind = 'test') > 0 AS BIGINT) AS adv_flow_has_test,
    CAST(count(*) FILTER (kind = 'edit') > 0 AS BIGINT) AS adv_flow_has_edit,
    coalesce(min(step_no) FILTER (kind = 'test'), -1) AS adv_flow_first_test_step,
    count(*) FILTER (kind_1 = 'edit' AND kind = 'test') AS adv_flow_edit_then_test,
    count(*) FILTER (kind IN ('read', 'search', 'edit', 'test')) / n AS adv_flow_productive_frac,
    count(*) FILTER (kind IN ('environment', 'other')) / n AS adv_flow_env_other_frac,
    CASE WHEN count(*) FILTER (kind = 'test') = 0 THEN count(*) FILTER (kind = 'edit') ELSE 0 END AS adv_flow_blind_edits,
    count(*) FILTER (new_read AND step_no > n - 5) AS adv_flow_new_files_last5,
    count(*) FILTER (kind = 'edit' AND step_no > last_prog) AS adv_flow_edits_since_progress,
    coalesce(max(t) - max(t) FILTER (report_improves), 0) AS adv_flow_test_no_improve_streak,
    avg(length(thought_text)) FILTER (step_no > n - 8)
      / greatest(1.0, avg(length(action_text)) FILTER (step_no > n - 8)) AS adv_flow_thought_action_ratio
  FROM (SELECT m.*, last_prog, err_now FROM mpre m JOIN prog p ON p.trajectory_id = m.trajectory_id AND p.n = m.n)
  GROUP BY trajectory_id, n),
kind_counts AS (
  SELECT trajectory_id, n, kind, count(*) AS c, count(*) FILTER (step_no > n - 10) AS c10,
    count(*) FILTER (step_no <= greatest(1, n // 2)) AS ch FROM mpre GROUP BY ALL),
entropies AS (
  SELECT trajectory_id, n, -sum(c / n * log2(c / n)) AS adv_seq_entropy,
    -sum(CASE WHEN c10 > 0 THEN c10 / least(10, n) * log2(c10 / least(10, n)) ELSE 0 END) AS adv_seq_entropy_last10,
    -sum(CASE WHEN ch > 0 THEN ch / greatest(1, n // 2) * log2(ch / greatest(1, n // 2)) ELSE 0 END) AS half_entropy
  FROM kind_counts GROUP BY trajectory_id, n),
obs_max AS (
  SELECT trajectory_id, n, max(c) AS obs_c FROM (
    SELECT trajectory_id, n, observation_text, count(*) AS c FROM mpre WHERE observation_text <> ''
    GROUP BY trajectory_id, n, observation_text) GROUP BY trajectory_id, n),
err_max AS (
  SELECT trajectory_id, n, max(c) AS err_c FROM (
    SELECT trajectory_id, n, split_part(observation_text, chr(10), 1) AS line, count(*) AS c FROM mpre
    WHERE observation_text <> '' AND is_err GROUP BY trajectory_id, n, line) GROUP BY trajectory_id, n),
dynamics AS (
  SELECT b.*, d.* EXCLUDE (trajectory_id, n), adv_seq_entropy, adv_seq_entropy_last10,
    half_entropy - adv_seq_entropy_last10 AS adv_seq_entropy_drop,
    coalesce(obs_c, 0) AS adv_seq_obs_repeat_max, CAST(coalesce(err_c, 0) AS BIGINT) AS adv_err_same_repeated,
    edited_before_any_read * n_edit AS adv_ix_premature_edit,
    max_command_repeat_count * adv_err_rate AS adv_ix_repeat_x_err,
    CASE WHEN n_test = 0 THEN n_edit ELSE 0 END AS adv_ix_blind_edit,
    adv_ts_progress * same_file_edit_count_max AS adv_ix_stall_x_churn
  FROM base_flags b JOIN dyn d ON d.trajectory_id = b.trajectory_id AND d.n = b.prefix_step
    JOIN entropies e ON e.trajectory_id = b.trajectory_id AND e.n = b.prefix_step
    LEFT JOIN obs_max o ON o.trajectory_id = b.trajectory_id AND o.n = b.prefix_step
    LEFT JOIN err_max x ON x.trajectory_id = b.trajectory_id AND x.n = b.prefix_step)"""
_DYNAMICS_DOUBLES = [f"adv_w{w}_{x}" for w in (5, 10) for x in ("edit_frac", "test_frac", "repeat_ratio", "err_frac", "obs_mean")] + [
    "adv_seq_entropy", "adv_seq_entropy_last10", "adv_seq_entropy_drop", "adv_seq_consec_cmd_sim",
    "adv_err_rate", "adv_flow_productive_frac", "adv_flow_env_other_frac", "adv_flow_thought_action_ratio",
    "adv_ix_premature_edit", "adv_ix_repeat_x_err", "adv_ix_blind_edit", "adv_ix_stall_x_churn"]
_DYNAMICS_LONGS = [f"adv_w{w}_{x}" for w in (5, 10) for x in ("n_edit", "n_test", "distinct_cmd")] + [
    f"adv_ts_{x}" for x in ("test", "edit", "search", "error", "new_file", "progress")] + [
    "adv_seq_bigram_repeat", "adv_seq_trigram_repeat", "adv_seq_longest_run", "adv_seq_obs_repeat_max",
    "adv_seq_obs_repeat_recent"] + [f"adv_err_{n}" for n in P.ERROR_CATEGORIES] + [
    "adv_err_streak", "adv_err_recent_total", "adv_err_same_repeated"] + [
    f"adv_flow_{x}" for x in ("has_test", "has_edit", "first_test_step", "edit_then_test", "blind_edits",
                              "new_files_last5", "edits_since_progress", "test_no_improve_streak")]
DYNAMICS_SQL = _DYNAMICS_SQL


@query("prefix_features_dynamics", "WITH " + _DYNAMICS_SQL + f"""
SELECT {", ".join(PX.META)}, {base_output_sql(FT.BASE_FEATURES)},
  {", ".join(f"round(CAST({c} AS DOUBLE), 6) AS f__{c}" for c in _DYNAMICS_DOUBLES)},
  {", ".join(f"CAST({c} AS BIGINT) AS f__{c}" for c in _DYNAMICS_LONGS)}
FROM dynamics""")
def prefix_features_dynamics(spark, sf):
    steps = S.steps(spark, sf)
    return rounded(FT.prefix_table(
        steps, S.runs(steps), features="dynamics", similarity="edit", compression=False))


@query("prefix_features_full")
def prefix_features_full(spark, sf):
    """Base and dynamics with matching-blocks similarity, compression and text."""
    steps = S.steps(spark, sf)
    return FT.prefix_table(steps, S.runs(steps), features="dynamics", text=True)


_PART = "concat_ws(chr(32) || chr(10) || chr(32), nullif(left(trim(action_text), 400), ''), nullif(left(trim(observation_text), 200), ''))"


@query("prefix_text", "WITH " + _PREFIX_ROWS + f"""
SELECT trajectory_id, n AS prefix_step,
  right(string_agg({_PART}, concat(' ', chr(10), ' ') ORDER BY step_no), 4000) AS text_blob
FROM pre GROUP BY ALL""")
def prefix_text(spark, sf):
    steps = S.steps(spark, sf)
    wanted = prefix_schedule(spark, sf)
    return by_run_length(steps, lambda part, scan: FT.recent_text(part, wanted, scan))


@query("prefix_features_full_exact", "WITH " + _DYNAMICS_SQL + f""",
texts AS (
  SELECT trajectory_id, n AS prefix_step, right(string_agg({_PART}, concat(' ', chr(10), ' ') ORDER BY step_no), 4000) AS f__text_blob
  FROM pre GROUP BY ALL)
SELECT {", ".join("dynamics." + c for c in PX.META)}, {base_output_sql(FT.BASE_FEATURES)},
  {", ".join(f"round(CAST({c} AS DOUBLE), 6) AS f__{c}" for c in _DYNAMICS_DOUBLES if c != "adv_seq_consec_cmd_sim")},
  {", ".join(f"CAST({c} AS BIGINT) AS f__{c}" for c in _DYNAMICS_LONGS)}, coalesce(f__text_blob, '') AS f__text_blob
FROM dynamics LEFT JOIN texts USING (trajectory_id, prefix_step)""")
def prefix_features_full_exact(spark, sf):
    """All of prefix_features_full but matching-blocks similarity and compression, which SQL cannot say."""
    return rounded(prefix_features_full(spark, sf).drop(
        "f__adv_seq_consec_cmd_sim", "f__adv_seq_compress", "f__adv_seq_compress_last10"))


@query("feature_table_rebuild_check", "WITH " + _PREFIX_ROWS + """
SELECT CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right, count(*) AS in_both FROM meta""")
def feature_table_rebuild_check(spark, sf):
    steps = S.steps(spark, sf)
    rebuilt = FT.prefix_table(steps, S.runs(steps), features="dynamics")
    return PX.same_prefix_ids(prefix_schedule(spark, sf), rebuilt)


@query("prefix_bounds_gate", "WITH " + _PREFIX_ROWS + """
SELECT count(*) AS n_rows, count(*) FILTER (prefix_step > n_total_steps) AS n_violations,
  count(*) FILTER (prefix_step < 1) AS n_below_one FROM meta""")
def prefix_bounds_gate(spark, sf):
    return PX.step_bound_violations(prefix_schedule(spark, sf))


@query("prefix_dataset_summary", "WITH " + _PREFIX_ROWS + """
SELECT count(*) AS n_prefixes, count(DISTINCT trajectory_id) AS n_runs, count(DISTINCT instance_id) AS n_instances,
  round(count(*) / count(DISTINCT trajectory_id), 6) AS prefixes_per_run, round(avg(y_fail), 6) AS fail_rate,
  min(prefix_step) AS step_min, median(prefix_step) AS step_median, max(prefix_step) AS step_max FROM meta""")
def prefix_dataset_summary(spark, sf):
    return rounded(PX.dataset_summary(prefix_schedule(spark, sf)))


_ENTITY = "CAST(regexp_matches(action_text, {}) AS DOUBLE)"


_STEP_INPUTS = "WITH " + CLASSIFIED + f""",
first_read AS (
  SELECT DISTINCT trajectory_id, arg_min(step_no, step_no) AS step_no
  FROM (SELECT trajectory_id, step_no, unnest(files) AS file FROM classified WHERE kind = 'read' AND step_index < 160)
  GROUP BY trajectory_id, file),
inputs AS (SELECT trajectory_id, step_index,
  {", ".join(f"CAST(CASE WHEN kind = 'unknown' THEN 'other' ELSE kind END = '{t}' AS DOUBLE) AS is_{t}" for t in P.ACTION_TYPES)},
  CAST(traceback AS DOUBLE) AS traceback, CAST(exception AS DOUBLE) AS exception,
  ln(1 + length(observation_text)) AS log_obs_len, coalesce(CAST(failed AS DOUBLE), 0) AS fail_count,
  CAST(failed IS NOT NULL AS DOUBLE) AS has_fail_count, ln(1 + len(files)) AS log_files,
  CAST((trajectory_id, step_no) IN (SELECT (trajectory_id, step_no) FROM first_read) AS DOUBLE) AS new_file,
  ln(1 + length(thought_text)) AS log_thought_len, ln(1 + length(action_text)) AS log_action_len,
  CAST(0 AS DOUBLE) AS bad_returncode
FROM classified WHERE step_index < 160)"""


@query("step_sequence_inputs", _STEP_INPUTS + f"""
SELECT trajectory_id, step_index, {", ".join(f"round({c}, 6) AS {c}" for c in FT.SEQUENCE_INPUTS)} FROM inputs""")
def step_sequence_inputs(spark, sf):
    return rounded(by_run_length(S.steps(spark, sf), lambda part, scan: FT.sequence_inputs(part, scan)))


_SCALED = ", ".join(f"round((i.{c} - s.m_{c}) / CASE WHEN s.d_{c} < 1e-6 THEN 1 ELSE s.d_{c} END, 6) AS {c}" for c in FT.SEQUENCE_INPUTS)


@query("step_inputs_standardized", _STEP_INPUTS + f""",
train AS (SELECT DISTINCT trajectory_id FROM steps WHERE CAST(('0x' || substr(md5(instance_id), 1, 8)) AS BIGINT) % 5 > 0),
s AS (
  SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}" for c in FT.SEQUENCE_INPUTS)}
  FROM inputs SEMI JOIN train USING (trajectory_id))
SELECT trajectory_id, step_index, {_SCALED} FROM inputs i, s""")
def step_inputs_standardized(spark, sf):
    """Inputs scaled with the statistics of the training instances (four of five, by hash)."""
    steps = S.steps(spark, sf)
    rows = by_run_length(steps, lambda part, scan: FT.sequence_inputs(part, scan))
    fold = S.runs(steps).select("trajectory_id", (T.hash_number(F.col("instance_id")) % 5).alias("fold"))
    train = rows.join(fold.where("fold > 0"), "trajectory_id", "left_semi")
    return rounded(FT.standardize(rows, train, FT.SEQUENCE_INPUTS))


@query("patch_churn_features", "WITH " + S.SQL["steps"] + """,
d AS (SELECT trajectory_id, step_index, step_no % 4 AS files, step_no * 3 % 17 AS added, step_no % 5 AS deleted,
    CAST(step_no % 2 AS BIGINT) AS dirty, CAST(event_type = 'view' AS BIGINT) AS better FROM steps),
g AS (SELECT *, greatest(0, added + deleted - coalesce(lag(added + deleted) OVER (PARTITION BY trajectory_id ORDER BY step_index), 0)) AS growth FROM d)
SELECT trajectory_id, step_index, files AS diff_files_changed, added AS diff_lines_added, deleted AS diff_lines_deleted,
  dirty AS working_tree_dirty, growth AS patch_growth_since_last_step,
  CASE WHEN better > 0 THEN 0 ELSE growth END AS patch_growth_without_test_improvement FROM g""")
def patch_churn_features(spark, sf):
    s = S.steps(spark, sf).select(
        "trajectory_id", "step_index", (F.col("event_type") == "view").cast("bigint").alias("tests_improving"))
    n = F.col("step_index") + 1
    stats = s.select("trajectory_id", "step_index", (n % 4).alias("files_changed"),
                     (n * 3 % 17).alias("lines_added"), (n % 5).alias("lines_deleted"), (n % 2).alias("dirty"))
    return by_run_length(
        s, lambda part, scan: FT.with_patch_features(part, stats, scan)).drop("tests_improving")
