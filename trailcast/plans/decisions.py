"""Queries over prefix features: labels, rules, interventions, policy replay, judge and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailcast.functions import text as T
from trailcast.operators import aggregates as AG
from trailcast.operators import audit as AU
from trailcast.operators import features as FT
from trailcast.operators import interventions as IV
from trailcast.operators import judge as J
from trailcast.operators import labels as LB

from trailcast.operators.scan import by_run_length, recent_list
from trailcast.operators.step_signals import classify
from trailcast.plans.evaluation import RISK, draws_sql, pair_auc, weighted_auc_sql
from trailcast.plans.features import BASE_SQL, CLASSIFIED, quoted, rounded
from trailcast.plans.registry import query
from trailcast.session import reuse
from trailcast.sources import standin as S


def prefixes(spark, sf):
    steps = S.steps(spark, sf)
    return FT.prefix_table(steps, S.runs(steps))


_TROUBLE = """(max_command_repeat_count >= 3 OR same_action_type_streak >= 5 OR repeated_exact_command_last_3 > 0
  OR (n_test_runs >= 2 AND (tests_worsening > 0 OR last_test_fail_count > 0)) OR n_tracebacks_seen >= 2
  OR (edited_file_never_read_count >= 1 AND n_edit >= 2))"""
_LABELS = "WITH " + BASE_SQL + f", tr AS (SELECT *, {_TROUBLE} AS trouble FROM base_flags)"


@query("weak_labels", _LABELS + """
SELECT prefix_id, CAST(trouble AS BIGINT) AS trouble, CAST(y_fail = 1 AND trouble AS BIGINT) AS y_gated,
  CAST(CASE WHEN y_fail = 1 AND NOT trouble THEN 0.3 ELSE 1.0 END AS DOUBLE) AS w_noisy,
  round(greatest(0.001, prefix_step / n_total_steps), 6) AS w_linear,
  round(greatest(0.001, (prefix_step / n_total_steps) * (prefix_step / n_total_steps)), 6) AS w_quadratic,
  round(greatest(0.001, prefix_step / n_total_steps + 0.3), 6) AS w_late FROM tr""")
def weak_labels(spark, sf):
    d = LB.position_weights(LB.shaped_labels(prefixes(spark, sf)))
    return rounded(d.select("prefix_id", "trouble", "y_gated", "w_noisy", "w_linear", "w_quadratic", "w_late"))


@query("trouble_onset", _LABELS + """
SELECT trajectory_id, max(n_total_steps) AS n_total_steps, max(y_fail) AS y_fail, min(prefix_step) FILTER (trouble) AS onset_step FROM tr GROUP BY 1""")
def trouble_onset(spark, sf):
    return LB.trouble_onset(prefixes(spark, sf))


@query("trouble_by_position", _LABELS + """
SELECT CASE WHEN prefix_step / n_total_steps <= 0.33 THEN 'early' WHEN prefix_step / n_total_steps <= 0.66 THEN 'mid' ELSE 'late' END AS stratum,
  count(*) AS n, round(avg(CAST(trouble AS BIGINT)), 6) AS trouble_share FROM tr WHERE y_fail = 1 GROUP BY 1""")
def trouble_by_position(spark, sf):
    return rounded(AG.trouble_share(LB.shaped_labels(prefixes(spark, sf))))


@query("onset_life_table", _LABELS + """,
o AS (SELECT trajectory_id, coalesce(min(prefix_step) FILTER (trouble), max(n_total_steps)) AS step, bool_or(trouble) AS event FROM tr GROUP BY 1),
h AS (SELECT step, count(*) AS exits, count(*) FILTER (event) AS events FROM o GROUP BY 1),
a AS (SELECT step, events, sum(exits) OVER (ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_risk FROM h)
SELECT step, CAST(at_risk AS BIGINT) AS at_risk, events, round(events / at_risk, 6) AS hazard,
  round(1 - product(1 - events / at_risk) OVER (ORDER BY step), 6) AS risk FROM a""")
def onset_life_table(spark, sf):
    return rounded(LB.life_table(reuse(LB.trouble_onset(prefixes(spark, sf)))))


@query("monotone_survival_risk", "WITH " + S.SQL["risk_steps"] + """
SELECT prefix_id, trajectory_id, prefix_step, round(greatest(1e-6, least(1 - 1e-6, 1 - product(1 - least(1 - 1e-12, risk / 20)) OVER (
  PARTITION BY trajectory_id ORDER BY prefix_step))), 6) AS risk FROM risk_steps""")
def monotone_survival_risk(spark, sf):
    h = S.risk(spark, sf, every_step=True).select(
        "prefix_id", "trajectory_id", "prefix_step", (F.col("risk") / 20).alias("hazard"))
    return rounded(by_run_length(h.withColumn("step_index", F.col("prefix_step") - 1), LB.survival_risk).select(
        "prefix_id", "trajectory_id", "prefix_step", "risk"))


_MODE = """CASE WHEN max_command_repeat_count >= 3 OR repeated_exact_command_last_3 > 0 OR same_action_type_streak >= 5 THEN 'looping'
  WHEN tests_worsening > 0 OR same_test_command_repeated >= 2 THEN 'patch_churn'
  WHEN edited_before_any_read > 0 OR edited_file_never_read_count > 0 THEN 'insufficient_context'
  WHEN n_edit > 0 AND n_test_runs = 0 THEN 'test_neglect'
  WHEN n_submit > 0 AND n_edit = 0 THEN 'submission_too_early'
  WHEN n_install >= 2 OR n_environment >= n_edit + n_read + 1 THEN 'environment_distraction'
  WHEN n_unique_files_edited >= 1 AND n_unique_files_read = 0 THEN 'wrong_file' ELSE 'not_observable' END"""


@query("failure_modes", "WITH " + BASE_SQL + f"""
SELECT prefix_id, {_MODE} AS failure_mode,
  round((CAST(edited_before_any_read > 0 AS BIGINT) + CAST(repeated_exact_command_last_3 > 0 AS BIGINT)
   + CAST(n_test_runs >= 2 AND tests_worsening > 0 AS BIGINT) + CAST(edited_file_never_read_count > 0 AS BIGINT)) / 5.0, 6) AS rule_score,
  round((CAST(edited_before_any_read > 0 AS BIGINT) + CAST(repeated_exact_command_last_3 > 0 AS BIGINT)
   + CAST(n_test_runs >= 2 AND tests_worsening > 0 AS BIGINT) + CAST(edited_file_never_read_count > 0 AS BIGINT)) / 4.0, 6) AS rule_score_present
FROM base_flags""")
def failure_modes(spark, sf):
    p = prefixes(spark, sf)
    return rounded(p.select("prefix_id", LB.failure_mode(p).alias("failure_mode"), LB.rule_score(p).alias("rule_score"),
                            LB.rule_score(p, skip_missing=True).alias("rule_score_present")))


@query("failure_mode_frequency", "WITH " + BASE_SQL + f""",
m AS (SELECT {_MODE} AS failure_mode FROM base_flags)
SELECT failure_mode, count(*) AS n, round(count(*) / (SELECT count(*) FROM m), 6) AS share,
  concat(count(*), ' (', CAST(round_even(count(*) / (SELECT count(*) FROM m) * 100, 0) AS BIGINT), '%)') AS label FROM m GROUP BY 1""")
def failure_mode_frequency(spark, sf):
    p = prefixes(spark, sf)
    return rounded(AG.frequency(reuse(p.select(LB.failure_mode(p).alias("failure_mode"))), "failure_mode"))


@query("shuffled_label_control", RISK + """,
a AS (SELECT prefix_id, row_number() OVER (ORDER BY md5(concat('42|', prefix_id)), prefix_id) AS no FROM risk),
b AS (SELECT y_fail AS y_shuffled, row_number() OVER (ORDER BY md5(concat('43|', prefix_id)), prefix_id) AS no FROM risk)
SELECT prefix_id, y_fail, y_shuffled FROM a JOIN b USING (no) JOIN risk USING (prefix_id)""")
def shuffled_label_control(spark, sf):
    return LB.shuffled_labels(reuse(S.risk(spark, sf).select("prefix_id", "y_fail")))


@query("numeric_coercion", """
SELECT conv_id, turn, coalesce(TRY_CAST(nullif(CASE turn % 4 WHEN 0 THEN CAST(turn AS VARCHAR) WHEN 1 THEN '1.5' WHEN 2 THEN role END, '') AS DOUBLE), 0.0) AS f__value,
  CAST(turn % 2 = 0 AS DOUBLE) AS f__flag FROM conversations""")
def numeric_coercion(spark, sf):
    c = S.table(spark, sf, "conversations").select(
        "conv_id", "turn", (F.col("turn") % 2 == 0).alias("f__flag"),
        F.when(F.col("turn") % 4 == 0, F.col("turn").cast("string")).when(F.col("turn") % 4 == 1, "1.5")
        .when(F.col("turn") % 4 == 2, F.col("role")).alias("f__value"))
    return LB.to_numbers(c, ["f__value", "f__flag"])


# ---------------------------------------------------------------- interventions


def with_recent(spark, sf):
    """Prefix features, a risk score and the last five commands of every scheduled prefix."""
    steps = S.steps(spark, sf)
    p = FT.prefix_table(steps, S.runs(steps))
    cmd = T.strip(T.or_empty(T.first_command(F.col("action_text")), F.col("action_text")))

    def job(part, scan):
        s = scan.apply(part.select("trajectory_id", "step_index", cmd.alias("cmd")), recent_commands=recent_list(F.col("cmd"), 5))
        return s.select("trajectory_id", (F.col("step_index") + 1).alias("prefix_step"), "recent_commands")

    risk = S.risk(spark, sf).select("prefix_id", "risk")
    return p.join(by_run_length(steps, job), ["trajectory_id", "prefix_step"]).join(risk, "prefix_id")


_DECIDE = "WITH " + BASE_SQL + """,
rs AS (SELECT trajectory_id, n AS prefix_step, round(1 / (1 + exp(-(count(*) FILTER (event_type = 'error') - count(*) FILTER (event_type = 'purchase')) / 3.0)), 6) AS risk FROM pre GROUP BY ALL),
five AS (SELECT trajectory_id, n AS prefix_step, action_text AS cmd, count(*) AS c, min(step_no) AS first FROM pre WHERE step_no > n - 5 GROUP BY ALL),
top AS (SELECT trajectory_id, prefix_step, arg_max(cmd, (c, -first)) AS cmd, max(c) AS c FROM five GROUP BY ALL),
trig AS (
  SELECT b.*, r.risk, t.cmd, t.c,
    repeated_exact_command_last_3 > 0 OR max_command_repeat_count >= 3 OR same_action_type_streak >= 4 OR edit_test_edit_test_loop_count >= 2 OR read_same_file_repeatedly >= 3 AS loop,
    n_edit > 0 AND (edited_before_any_read > 0 OR edited_file_never_read_count > 0 OR (n_reads_before_first_edit = 0 AND n_searches_before_first_edit = 0)) AS evidence,
    prefix_step % 2 = 0 AND (tests_worsening > 0 OR test_fail_count_delta > 0) AS rollback
  FROM base_flags b JOIN rs r USING (trajectory_id, prefix_step) JOIN top t USING (trajectory_id, prefix_step))"""
_BREAK = quoted(IV.LOOP_BREAK_MESSAGE.replace("%1$s", "<c>").replace("%2$d", "<n>"))


@query("chosen_interventions", _DECIDE + f""",
k AS (SELECT *, CASE WHEN risk >= 0.8 AND rollback THEN 'rollback_suggest' WHEN risk >= 0.5 AND evidence THEN 'evidence_gate'
  WHEN risk >= 0.5 AND loop AND c >= 2 THEN 'loop_break' WHEN risk >= 0.5 AND loop THEN 'loop_guard' ELSE 'none' END AS kind FROM trig)
SELECT prefix_id, CAST(loop AS BIGINT) AS loop, CAST(evidence AS BIGINT) AS evidence_gate, CAST(rollback AS BIGINT) AS rollback, kind,
  CASE kind WHEN 'loop_break' THEN cmd END AS target_command, CAST(CASE kind WHEN 'loop_break' THEN 8.0 ELSE 0.0 END AS DOUBLE) AS penalty,
  CASE kind WHEN 'loop_break' THEN concat('loop on repeated command (x', c, ')') WHEN 'rollback_suggest' THEN 'very-high risk + worsening tests/churn + checkpoint'
    WHEN 'evidence_gate' THEN 'high risk + edits before sufficient evidence' WHEN 'loop_guard' THEN 'high risk + repeated actions / loop'
    ELSE 'no trigger at required risk level' END AS reason,
  CASE kind WHEN 'loop_break' THEN replace(replace({_BREAK}, '<c>', cmd), '<n>', CAST(c AS VARCHAR))
    WHEN 'rollback_suggest' THEN {quoted(IV.ROLLBACK_MESSAGE)} WHEN 'evidence_gate' THEN {quoted(IV.EVIDENCE_GATE_MESSAGE)}
    WHEN 'loop_guard' THEN {quoted(IV.LOOP_GUARD_MESSAGE)} ELSE '' END AS message FROM k""")
def chosen_interventions(spark, sf):
    d = IV.decide(with_recent(spark, sf), has_checkpoint=F.col("prefix_step") % 2 == 0)
    return d.select("prefix_id", F.col("loop").cast("bigint").alias("loop"), F.col("evidence_gate").cast("bigint").alias("evidence_gate"),
                    F.col("rollback").cast("bigint").alias("rollback"), "kind", "target_command", "penalty", "reason", "message")


@query("forced_interventions", _DECIDE + """,
f AS (
  SELECT prefix_id, 'loop_break' AS forced, CASE WHEN loop AND c >= 2 THEN 'loop_break' WHEN loop THEN 'loop_guard' ELSE 'none' END AS kind FROM trig
  UNION ALL SELECT prefix_id, 'loop_guard', CASE WHEN loop THEN 'loop_guard' ELSE 'none' END FROM trig
  UNION ALL SELECT prefix_id, 'evidence_gate', CASE WHEN evidence THEN 'evidence_gate' ELSE 'none' END FROM trig
  UNION ALL SELECT prefix_id, 'rollback_suggest', CASE WHEN rollback THEN 'rollback_suggest' ELSE 'none' END FROM trig)
SELECT forced, kind, count(*) AS n FROM f GROUP BY ALL""")
def forced_interventions(spark, sf):
    rows = reuse(with_recent(spark, sf))
    out = None
    for forced in ("loop_break", "loop_guard", "evidence_gate", "rollback_suggest"):
        one = IV.decide(rows, has_checkpoint=F.col("prefix_step") % 2 == 0, forced_kind=forced).groupBy("kind").agg(
            F.count(F.lit(1)).alias("n")).withColumn("forced", F.lit(forced))
        out = one if out is None else out.unionByName(one)
    return out


@query("most_repeated_commands", _DECIDE + """
SELECT trajectory_id, prefix_step, CASE WHEN c >= 2 THEN cmd END AS command, CASE WHEN c >= 2 THEN c ELSE 0 END AS count FROM top""")
def most_repeated_commands(spark, sf):
    r = with_recent(spark, sf).withColumn("best", IV.most_repeated(F.col("recent_commands")))
    return r.select("trajectory_id", "prefix_step", F.col("best.command").alias("command"),
                    F.coalesce("best.count", F.lit(0)).cast("bigint").alias("count"))


_ELIGIBLE = "prefix_step >= {floor} AND abs(risk - 0.5) >= {conf} AND risk >= {t}"


def replay_sql(name: str, floor: int, conf: float, t: float, cooldown: int = 3) -> str:
    """Closed form for a budget of two."""
    return f"""
{name}_e AS (SELECT trajectory_id, prefix_step FROM risk_steps WHERE {_ELIGIBLE.format(floor=floor, conf=conf, t=t)}),
{name}_1 AS (SELECT trajectory_id, min(prefix_step) AS a1 FROM {name}_e GROUP BY 1),
{name}_2 AS (SELECT e.trajectory_id, min(prefix_step) AS a2 FROM {name}_e e JOIN {name}_1 f ON e.trajectory_id = f.trajectory_id AND prefix_step >= a1 + {cooldown} GROUP BY 1),
{name} AS (SELECT trajectory_id, y_fail, n_total_steps, a1, a2, (a1 IS NOT NULL)::BIGINT + (a2 IS NOT NULL)::BIGINT AS n
  FROM runs LEFT JOIN {name}_1 USING (trajectory_id) LEFT JOIN {name}_2 USING (trajectory_id))"""


@query("policy_replay", "WITH " + S.SQL["risk_steps"] + "," + replay_sql("u", 5, 0.0, 0.7) + """
SELECT trajectory_id, y_fail, n_total_steps, n AS n_alarms, a1 AS first_alarm, a2 AS second_alarm FROM u""")
def policy_replay(spark, sf):
    r = IV.replay(S.risk(spark, sf, every_step=True), 0.7, step_floor=5)
    return r.select("trajectory_id", "y_fail", "n_total_steps", F.size("alarms").cast("bigint").alias("n_alarms"),
                    F.get("alarms", F.lit(0)).alias("first_alarm"), F.get("alarms", F.lit(1)).alias("second_alarm"))


@query("policy_replay_comparison", "WITH " + S.SQL["risk_steps"] + "," + replay_sql("u", 5, 0.0, 0.7) + "," + replay_sql("g", 10, 0.25, 0.7) + """,
b AS (SELECT 'ungated' AS policy, * FROM u UNION ALL SELECT 'gated', * FROM g)
SELECT policy, y_fail, count(*) AS n_runs, round(avg(CAST(n > 0 AS BIGINT)), 6) AS fire_rate, CAST(sum(n) AS BIGINT) AS total_alarms,
  count(*) FILTER (a1 < 0.5 * n_total_steps) AS early_alarms, round(avg(a1 / n_total_steps), 6) AS mean_first_fraction FROM b GROUP BY ALL""")
def policy_replay_comparison(spark, sf):
    r = reuse(S.risk(spark, sf, every_step=True))
    return rounded(IV.compare_policies(r, {"threshold": 0.7, "step_floor": 5},
                                       {"threshold": 0.7, "step_floor": 10, "conf_floor": 0.25}))


@query("alarm_verdicts", "WITH " + S.SQL["risk_steps"] + "," + replay_sql("u", 5, 0.1, 0.6, cooldown=5) + """
SELECT r.prefix_id, CAST(prefix_step = coalesce(a1, -1) OR prefix_step = coalesce(a2, -1) AS BIGINT) AS alarm,
  CAST(prefix_step < 5 OR abs(risk - 0.5) < 0.1 AS BIGINT) AS abstain FROM risk_steps r JOIN u USING (trajectory_id)""")
def alarm_verdicts(spark, sf):
    r = reuse(S.risk(spark, sf, every_step=True))
    fired = IV.alarmed_steps(r, 0.6, conf_floor=0.1).withColumn("alarm", F.lit(1).cast("bigint"))
    return r.join(fired, ["trajectory_id", "prefix_step"], "left").select(
        "prefix_id", F.coalesce("alarm", F.lit(0)).cast("bigint").alias("alarm"),
        ((F.col("prefix_step") < 5) | (F.abs(F.col("risk") - 0.5) < 0.1)).cast("bigint").alias("abstain"))


_PAIRED = "WITH " + S.SQL["paired_runs"] + """,
pairs AS (SELECT p.policy, b.success AS sb, p.success AS sp, b.n_steps AS nb, p.n_steps AS np, p.n_interventions AS ni
  FROM paired_runs b JOIN paired_runs p ON b.instance_id = p.instance_id AND b.arm = 'baseline' AND p.arm = 'policy')"""


@query("intervention_accounting", _PAIRED + """
SELECT policy, count(*) AS n_tasks, round(avg(sb), 6) AS baseline_success_rate, round(avg(sp), 6) AS policy_success_rate,
  count(*) FILTER (sb = 0 AND sp = 1) AS recovery_count, count(*) FILTER (sb = 1 AND sp = 0) AS disruption_count,
  count(*) FILTER (sb = 1 AND sp = 1) AS unchanged_success_count, count(*) FILTER (sb = 0 AND sp = 0) AS unchanged_failure_count,
  count(*) FILTER (sb = 1 AND sp = 1 AND np < nb) AS safe_saving_count, count(*) FILTER (sb = 1 AND sp = 1 AND np > nb) AS harmful_waste_count,
  round(avg(nb), 6) AS avg_steps_baseline, round(avg(np), 6) AS avg_steps_policy, round(avg(ni), 6) AS interventions_per_run FROM pairs GROUP BY 1""")
def intervention_accounting(spark, sf):
    r = S.paired_runs(spark, sf)
    return rounded(IV.accounting(r.where("arm = 'baseline'"), r.where("arm = 'policy'"), ["policy"]))


@query("shadow_equivalence", _PAIRED + """
SELECT count(*) AS n_tasks, count(*) FILTER (np = nb) AS same_n_steps, count(*) FILTER (sp = sb) AS same_success,
  CAST(bool_and(np = nb AND sp = sb) AS BIGINT) AS identical FROM pairs""")
def shadow_equivalence(spark, sf):
    r = S.paired_runs(spark, sf)
    return IV.same_behaviour(r.where("arm = 'baseline'"), r.where("arm = 'policy'"))


@query("arm_outcomes", "WITH " + S.SQL["paired_runs"] + """
SELECT arm, round(avg(success), 6) AS solve_rate, round(avg(CAST(n_loops > 0 AS BIGINT)), 6) AS loop_rate, round(avg(n_steps), 6) AS mean_steps, count(*) AS n
FROM paired_runs GROUP BY 1""")
def arm_outcomes(spark, sf):
    return rounded(IV.arm_outcomes(S.paired_runs(spark, sf)))


@query("lift_by_difficulty", "WITH " + S.SQL["paired_runs"] + """,
f AS (SELECT b.difficulty, b.success AS c, p.success AS t FROM paired_runs b JOIN paired_runs p ON b.instance_id = p.instance_id
  AND b.arm = 'baseline' AND p.arm = 'policy' WHERE b.n_loops > 0 AND b.success = 0)
SELECT coalesce(difficulty, 'ALL') AS difficulty, count(*) AS n, CAST(sum(c) AS BIGINT) AS control_solved, CAST(sum(t) AS BIGINT) AS treatment_solved,
  CAST(sum(t) - sum(c) AS BIGINT) AS lift FROM f GROUP BY ROLLUP (difficulty)""")
def lift_by_difficulty(spark, sf):
    return IV.lift_by_difficulty(S.paired_runs(spark, sf), ["instance_id"])


@query("cost_resource_table", "WITH " + S.SQL["paired_runs"] + """,
specs AS (SELECT 'model-0' AS model, '4.7GB' AS model_size, '32K' AS context_window)
SELECT model, policy, coalesce(any_value(model_size), '?') AS model_size, coalesce(any_value(context_window), '?') AS context_window,
  round(avg(total_tokens_approx) / avg(runtime_s), 6) AS avg_tokens_per_sec, round(avg(runtime_s), 4) AS avg_run_time_s,
  round(avg(n_steps), 6) AS avg_steps, round(avg(success), 6) AS success_rate, count(*) AS n_runs
FROM paired_runs LEFT JOIN specs USING (model) GROUP BY model, policy""")
def cost_resource_table(spark, sf):
    specs = spark.createDataFrame([("model-0", "4.7GB", "32K")], "model string, model_size string, context_window string")
    t = AG.cost_table(S.paired_runs(spark, sf), specs)
    return rounded(t.withColumn("avg_run_time_s", F.round("avg_run_time_s", 4)))


@query("loop_gate", "WITH " + S.SQL["steps"] + """,
x AS (SELECT trajectory_id, step_index, action_text = lag(action_text) OVER w AS rep,
    list_filter([TRY_CAST(nullif(regexp_extract(lag(observation_text, 2) OVER w, '(\\d+)', 1), '') AS BIGINT),
      TRY_CAST(nullif(regexp_extract(lag(observation_text) OVER w, '(\\d+)', 1), '') AS BIGINT),
      TRY_CAST(nullif(regexp_extract(observation_text, '(\\d+)', 1), '') AS BIGINT)], lambda v: v IS NOT NULL) AS xs
  FROM steps WINDOW w AS (PARTITION BY trajectory_id ORDER BY step_index)),
y AS (SELECT *, coalesce(rep, false) AS r, len(xs) >= 2 AND xs[2] < xs[1] AND coalesce(xs[3] < xs[2], true) AS imp FROM x)
SELECT trajectory_id, step_index, CAST(r AS BIGINT) AS repeated, CAST(coalesce(imp, false) AS BIGINT) AS improving,
  CAST(r AND NOT coalesce(imp, false) AS BIGINT) AS gate_fires FROM y""")
def loop_gate(spark, sf):
    s = S.steps(spark, sf).withColumn("command", T.first_command(F.col("action_text")))
    return by_run_length(s, IV.loop_gate)


@query("loops_per_run", "WITH " + S.SQL["steps"] + """,
x AS (SELECT trajectory_id, step_index, list_filter(list(action_text) OVER (PARTITION BY trajectory_id ORDER BY step_index ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
    lambda c: NOT starts_with(c, 'python test') AND NOT starts_with(c, 'pytest')) AS before FROM steps)
SELECT trajectory_id, count(*) FILTER (len(before) > len(list_distinct(before))) AS n_loops, count(*) AS n_steps FROM x GROUP BY 1""")
def loops_per_run(spark, sf):
    s = S.steps(spark, sf).withColumn("command", T.or_empty(T.first_command(F.col("action_text"))))
    return by_run_length(s, IV.loops_in_window)


@query("success_rate_by_model", RISK + """,
p AS (SELECT model_name, trajectory_id, max(y_fail) AS y, any_value(instance_id) AS i FROM risk GROUP BY ALL)
SELECT model_name, round(1 - avg(y), 6) AS success_rate, count(*) AS n_runs, count(DISTINCT i) AS n_instances FROM p GROUP BY 1""")
def success_rate_by_model(spark, sf):
    return rounded(AG.run_success_rate(S.risk(spark, sf), ["model_name"]))


@query("latency_statistics", """
SELECT event_type, round(median(value), 6) AS median_ms, round(quantile_cont(value, 0.1), 6) AS p10_ms, round(quantile_cont(value, 0.9), 6) AS p90_ms,
  count(*) AS n, round(1000.0 * count(*) / sum(value), 6) AS per_second FROM events GROUP BY 1""")
def latency_statistics(spark, sf):
    return rounded(AG.latency(S.table(spark, sf, "events"), "value", ["event_type"]))


# ---------------------------------------------------------------- judge


def judged(spark, sf):
    """Replies to the scheduled prefixes: a third plain JSON, a third fenced, a third broken."""
    r = S.risk(spark, sf)
    h = T.hash_number(F.col("prefix_id"))
    score = F.format_string("0.%02d", h % 100)
    body = F.concat(F.lit('{"risk_score": '), score, F.lit(', "likely_failure_modes": ["loop"], "should_intervene": '),
                    (h % 2 == 0).cast("string"), F.lit(', "intervention_type": "'),
                    F.when(h % 5 == 0, "dance").otherwise("loop_guard"), F.lit('", "evidence": []}'))
    reply = (F.when(h % 3 == 0, body).when(h % 3 == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nok")))
             .otherwise(F.concat(F.lit("no idea "), score)))
    return r.withColumns({
        "reply": reply, "latency_s": (h % 700) / 100.0, "prompt_tokens": h % 900, "completion_tokens": h % 60})


_JUDGED = RISK + """,
h AS (SELECT *, CAST(('0x' || substr(md5(prefix_id), 1, 8)) AS BIGINT) AS h FROM risk),
judged AS (
  SELECT *, CAST(h % 3 < 2 AS BIGINT) AS valid_json, CASE WHEN h % 3 < 2 THEN (h % 100) / 100.0 ELSE 0.5 END AS judge_risk,
    CAST(h % 3 < 2 AND h % 2 = 0 AS BIGINT) AS should_intervene,
    CASE WHEN h % 3 < 2 AND h % 5 <> 0 THEN 'loop_guard' ELSE 'none' END AS intervention_type, (h % 700) / 100.0 AS latency_s,
    h % 900 AS prompt_tokens, h % 60 AS completion_tokens FROM h)"""


@query("judge_replies", _JUDGED + """
SELECT prefix_id, valid_json, round(CAST(judge_risk AS DOUBLE), 6) AS judge_risk, should_intervene, intervention_type FROM judged""")
def judge_replies(spark, sf):
    return rounded(J.read_replies(judged(spark, sf)).select(
        "prefix_id", "valid_json", "judge_risk", "should_intervene", "intervention_type"))


def _ap_sql(score: str) -> str:
    return (f"(SELECT sum(pos * tp / (tp + fp)) / sum(pos) FROM (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp "
            f"FROM (SELECT {score} AS s, sum(y_fail) AS pos, sum(1 - y_fail) AS neg FROM judged GROUP BY 1)))")


@query("judge_report", _JUDGED + "," + draws_sql("risk", "instance_id", 2000, 42) + f""",
b AS ({weighted_auc_sql('risk').replace('FROM risk JOIN', 'FROM judged JOIN')}), n AS ({weighted_auc_sql('judge_risk').replace('FROM risk JOIN', 'FROM judged JOIN')}),
d AS (SELECT n.value - b.value AS d FROM b JOIN n USING (replicate))
SELECT count(*) AS n, CAST(sum(y_fail) AS BIGINT) AS n_pos, round(1 - avg(valid_json), 6) AS invalid_json_rate, round(avg(latency_s), 6) AS avg_latency_s,
  round(avg(should_intervene), 6) AS should_intervene_rate, round((SELECT auc FROM ({pair_auc('judged', score='judge_risk')})), 6) AS judge_auc,
  round({_ap_sql('judge_risk')}, 6) AS judge_auprc, round({_ap_sql('risk')}, 6) AS classifier_auprc,
  round((SELECT auc FROM ({pair_auc('(SELECT * FROM judged WHERE valid_json = 1)', score='judge_risk')})), 6) AS judge_auc_valid,
  round((SELECT auc FROM ({pair_auc('judged')})), 4) AS classifier_auc,
  round((SELECT auc FROM ({pair_auc('judged', score='judge_risk')})) - (SELECT auc FROM ({pair_auc('judged')})), 4) AS delta_judge,
  (SELECT round(quantile_cont(d, 0.025), 4) FROM d) AS delta_lo, (SELECT round(quantile_cont(d, 0.975), 4) FROM d) AS delta_hi,
  (SELECT round(count(*) FILTER (d > 0) / count(*), 3) FROM d) AS frac_judge_better FROM judged""")
def judge_report(spark, sf):
    return rounded(J.report(reuse(J.read_replies(judged(spark, sf)))))


@query("judge_costs", _JUDGED + """
SELECT count(*) AS n, CAST(sum(prompt_tokens) AS BIGINT) AS tokens_in, CAST(sum(completion_tokens) AS BIGINT) AS tokens_out,
  round(sum(prompt_tokens) / 1e6 * 1.25 + sum(completion_tokens) / 1e6 * 10, 6) AS cost,
  round((sum(prompt_tokens) + sum(completion_tokens)) / count(*), 6) AS tokens_per_call,
  round((sum(prompt_tokens) / 1e6 * 1.25 + sum(completion_tokens) / 1e6 * 10) / count(*) * 200, 6) AS projected_cost FROM judged""")
def judge_costs(spark, sf):
    return rounded(J.costs(judged(spark, sf), 1.25, 10.0, 200))


_RENDERED = CLASSIFIED + """,
lines AS (SELECT *, concat('[step ', step_no, '] (', kind, ') $ ', left(replace(trim(action_text), chr(10), ' '), 240),
  CASE WHEN observation_text <> '' THEN concat(chr(10), '    -> ', replace(left(trim(observation_text), 300), chr(10), ' ')) ELSE '' END) AS line FROM classified),
rendered AS (SELECT trajectory_id, step_no AS prefix_step, array_to_string(list(line) OVER (PARTITION BY trajectory_id ORDER BY step_no ROWS 11 PRECEDING), chr(10)) AS transcript FROM lines)"""


@query("judge_requests", "WITH " + _RENDERED + f"""
SELECT substr(sha1(concat(trajectory_id, chr(31), prefix_step)), 1, 12) AS prefix_id, trajectory_id, prefix_step,
  {quoted(J.SYSTEM_PROMPT)} AS system, replace(replace({quoted(J.USER_PROMPT.replace('%d', '<n>').replace('%s', '<t>'))}, '<n>', CAST(prefix_step AS VARCHAR)), '<t>', transcript) AS user
FROM (SELECT *, prefix_step - 1 AS step_index FROM rendered) JOIN runs USING (trajectory_id) WHERE """ + S.ON_SCHEDULE_SQL)
def judge_requests(spark, sf):
    rendered = by_run_length(classify(S.steps(spark, sf)), J.transcripts)
    return J.requests(S.risk(spark, sf).select("prefix_id", "trajectory_id", "prefix_step"), rendered)


@query("pinned_prefix_list", RISK + """,
l AS (SELECT prefix_id, row_number() OVER (ORDER BY md5(concat('9|', prefix_id)), prefix_id) - 1 AS place FROM risk ORDER BY 2 LIMIT 200)
SELECT CAST(place AS BIGINT) AS place, prefix_id, risk FROM l JOIN risk USING (prefix_id)""")
def pinned_prefix_list(spark, sf):
    """Rows of a given id list, in list order."""
    r = reuse(S.risk(spark, sf))
    top = r.select("prefix_id").orderBy(T.hash_key(F.lit(9), F.col("prefix_id")), "prefix_id").limit(200)
    ids = top.agg(F.transform(F.array_sort(F.collect_list(F.struct(
        T.hash_key(F.lit(9), F.col("prefix_id")).alias("h"), "prefix_id"))), lambda x: x["prefix_id"]).alias("ids"))
    listed = ids.select(F.posexplode("ids").alias("place", "prefix_id"))
    return listed.join(r, "prefix_id").select(F.col("place").cast("bigint").alias("place"), "prefix_id", "risk").orderBy("place")


# ---------------------------------------------------------------- audit


@query("audit_quadrants", RISK + """
SELECT kind, count(*) AS n, round(avg(risk), 6) AS mean_risk FROM (
  SELECT CASE WHEN risk >= 0.6 AND y_fail = 1 THEN 'true_positive' WHEN risk >= 0.6 THEN 'false_positive'
    WHEN y_fail = 1 THEN 'false_negative' ELSE 'true_negative' END AS kind, risk FROM risk) GROUP BY 1
UNION ALL SELECT 'high_risk', count(*), round(avg(risk), 6) FROM risk""")
def audit_quadrants(spark, sf):
    r = S.risk(spark, sf)
    names = ["true_positive", "false_positive", "false_negative", "true_negative", "high_risk"]
    out = None
    for n in names:
        one = AU.quadrant(r, n, 0.6).agg(F.count(F.lit(1)).alias("n"), F.avg("risk").alias("mean_risk")).withColumn("kind", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


_CONTEXT = CLASSIFIED + """,
ctx AS (SELECT trajectory_id, step_no AS prefix_step,
  list(concat('(', kind, ') ', left(trim(action_text), 80))) OVER (PARTITION BY trajectory_id ORDER BY step_no ROWS 4 PRECEDING) AS a,
  list(left(replace(trim(observation_text), chr(10), ' '), 120)) OVER (PARTITION BY trajectory_id ORDER BY step_no ROWS 2 PRECEDING) AS o FROM classified)"""


def _risk_after(ctes: str) -> str:
    """Risk CTEs behind a list that already has the events."""
    return ctes + S.SQL["risk"].replace(S.SQL["events"], "", 1)


@query("audit_quadrant_sample", "WITH " + _risk_after(_CONTEXT) + """
SELECT prefix_id, trajectory_id, prefix_step, risk, array_to_string(a, '|') AS last_actions, array_to_string(o, '|') AS last_observations
FROM (SELECT * FROM risk WHERE risk >= 0.6 AND y_fail = 1 ORDER BY risk DESC, prefix_id LIMIT 60) JOIN ctx USING (trajectory_id, prefix_step)""")
def audit_quadrant_sample(spark, sf):
    context = by_run_length(classify(S.steps(spark, sf)), AU.recent_context)
    s = AU.quadrant_sample(S.risk(spark, sf), "true_positive", 0.6, 60, context)
    return s.select("prefix_id", "trajectory_id", "prefix_step", "risk", F.array_join("last_actions", "|").alias("last_actions"),
                    F.array_join("last_observations", "|").alias("last_observations"))


@query("audit_ending_loops", "WITH " + _risk_after(_CONTEXT) + """
SELECT prefix_id, regexp_replace(a[-1], '^\\(\\w+\\)\\s*', '') AS command FROM risk JOIN ctx USING (trajectory_id, prefix_step)
WHERE len(a) >= 2 AND a[-1] = a[-2] AND length(regexp_replace(a[-1], '^\\(\\w+\\)\\s*', '')) > 3 ORDER BY prefix_id LIMIT 24""")
def audit_ending_loops(spark, sf):
    context = by_run_length(classify(S.steps(spark, sf)), AU.recent_context)
    return AU.ending_loops(S.risk(spark, sf).join(context, ["trajectory_id", "prefix_step"]), 24)


@query("audit_blind_rendering", "WITH " + CLASSIFIED + """,
l AS (SELECT *, concat('[', step_index, '] (', kind, ') $ ', left(action_text, 160), CASE WHEN observation_text <> '' THEN
    concat(chr(10), '      -> ', left(regexp_replace(trim(observation_text), '\\s+', ' ', 'g'), 240)) ELSE '' END) AS line,
    first_value(left(regexp_replace(trim(observation_text), '\\s+', ' ', 'g'), 600)) OVER (PARTITION BY trajectory_id ORDER BY step_index) AS goal FROM classified)
SELECT trajectory_id, step_no AS prefix_step, concat('TASK/CONTEXT (step 0 obs): ', goal, chr(10), '--- recent steps ---', chr(10),
  array_to_string(list(line) OVER (PARTITION BY trajectory_id ORDER BY step_no ROWS 11 PRECEDING), chr(10))) AS rendered FROM l""")
def audit_blind_rendering(spark, sf):
    return by_run_length(classify(S.steps(spark, sf)), AU.blind_rendering)


@query("audit_blind_sample", RISK + """,
pick AS (
  SELECT kind, prefix_id, instance_id, trajectory_id FROM (
    SELECT 'flagged_failure' AS kind, trajectory_id, instance_id, arg_max(prefix_id, (risk, prefix_step)) AS prefix_id FROM risk WHERE y_fail = 1 AND risk >= 0.6 GROUP BY ALL
    UNION ALL SELECT 'missed_failure', trajectory_id, instance_id, arg_max(prefix_id, prefix_step) FROM risk WHERE y_fail = 1 AND risk < 0.6 GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY kind, instance_id ORDER BY trajectory_id) = 1),
kept AS (SELECT * FROM pick QUALIFY row_number() OVER (PARTITION BY kind ORDER BY md5(concat('7|', prefix_id)), prefix_id) <= CASE kind WHEN 'flagged_failure' THEN 40 ELSE 10 END)
SELECT concat('A', lpad(CAST(row_number() OVER (ORDER BY md5(concat('8|', prefix_id)), prefix_id) - 1 AS VARCHAR), 2, '0')) AS id, kind, prefix_id, instance_id, trajectory_id FROM kept""")
def audit_blind_sample(spark, sf):
    return AU.blind_sample(reuse(S.risk(spark, sf)), 0.6).select("id", "kind", "prefix_id", "instance_id", "trajectory_id")


def audit_labels(spark, sf):
    """Two hash-chosen modes per document: a rule's and a person's."""
    modes = F.array(*[F.lit(m) for m in LB.FAILURE_MODES])
    d = S.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"))

    def mode(salt: str):
        return F.element_at(modes, (T.hash_number(F.lit(salt), F.col("id")) % 8 + 1).cast("int"))

    rule = mode("rule")
    human = F.when(T.hash_number(F.lit("same"), F.col("id")) % 3 == 0, rule).otherwise(mode("human"))
    kind = F.when(T.hash_number(F.lit("kind"), F.col("id")) % 5 == 0, "missed_failure").otherwise("flagged_failure")
    key = d.select("id", kind.alias("kind"), rule.alias("heuristic_failure_mode"))
    return key, d.select("id", human.alias("human_mode"))


_MODES = "[" + ", ".join(f"'{m}'" for m in LB.FAILURE_MODES) + "]"
_AUDIT = f"""WITH hashed AS (SELECT CAST(doc_id AS VARCHAR) AS id FROM documents),
nums AS (SELECT id, {", ".join(f"CAST(('0x' || substr(md5(concat('{s}|', id)), 1, 8)) AS BIGINT) AS h_{s}" for s in ("rule", "human", "same", "kind"))} FROM hashed),
audit AS (SELECT id, CASE WHEN h_kind % 5 = 0 THEN 'missed_failure' ELSE 'flagged_failure' END AS kind, {_MODES}[h_rule % 8 + 1] AS rule,
  CASE WHEN h_same % 3 = 0 THEN {_MODES}[h_rule % 8 + 1] ELSE {_MODES}[h_human % 8 + 1] END AS human FROM nums),
fam AS (SELECT * FROM (VALUES {", ".join(f"('{m}', '{f}')" for m, f in AU.MODE_FAMILIES.items())}) f(mode, family))"""


@query("audit_agreement", _AUDIT + """,
r AS (SELECT a.*, fr.family = fh.family AS coarse FROM audit a JOIN fam fr ON fr.mode = rule JOIN fam fh ON fh.mode = human),
g AS (SELECT kind AS "group", * FROM r UNION ALL SELECT 'all', * FROM r)
SELECT "group", count(*) AS n, round(avg(CAST(rule = human AS BIGINT)), 6) AS exact_agreement, round(avg(CAST(coarse AS BIGINT)), 6) AS coarse_agreement,
  round(avg(CAST(rule = 'looping' AS BIGINT)), 6) AS looping_rule, round(avg(CAST(human = 'looping' AS BIGINT)), 6) AS looping_human,
  round(avg(CAST(rule IN ('looping', 'patch_churn') AS BIGINT)), 6) AS repetition_rule, round(avg(CAST(human IN ('looping', 'patch_churn') AS BIGINT)), 6) AS repetition_human,
  round(count(*) FILTER (rule = 'looping' AND human = 'looping') / greatest(1, count(*) FILTER (rule = 'looping')), 6) AS looping_precision,
  round(count(*) FILTER (rule = 'looping' AND human = 'looping') / greatest(1, count(*) FILTER (human = 'looping')), 6) AS looping_recall,
  round(avg(CAST(human IN ('not_observable', 'insufficient_context') AS BIGINT)), 6) AS not_observable_human FROM g GROUP BY 1""")
def audit_agreement(spark, sf):
    return rounded(AU.agreement(*audit_labels(spark, sf)))


@query("audit_mode_distribution", _AUDIT + """,
l AS (SELECT kind, 'human' AS source, human AS mode FROM audit UNION ALL SELECT kind, 'rule', rule FROM audit),
c AS (SELECT kind, source, mode, count(*) AS n FROM l GROUP BY kind, source, mode),
t AS (SELECT *, n / sum(n) OVER (PARTITION BY kind, source) AS share FROM c)
SELECT kind, source, mode, n, round(share, 6) AS share, concat(n, ' (', CAST(round_even(share * 100, 0) AS BIGINT), '%)') AS label FROM t""")
def audit_mode_distribution(spark, sf):
    return rounded(AU.mode_distribution(*audit_labels(spark, sf)))
