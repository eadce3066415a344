"""Queries over the risk table: metrics, alerts, abstention, samples and splits.

SQL twins state the definition (pairs of rows for AUC, a join per threshold), not the
bucketed form the Spark side uses.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trailcast.operators import abstention as AB
from trailcast.operators import alerts as AL
from trailcast.operators import metrics as M
from trailcast.operators import resampling as RS
from trailcast.operators import sampling as SA
from trailcast.operators import splits as SP
from trailcast.operators.aggregates import position_profile, position_strata_auc
from trailcast.functions import text as T
from trailcast.plans.features import rounded
from trailcast.plans.registry import query
from trailcast.session import cut_lineage
from trailcast.sources import standin as S

RISK = "WITH " + S.SQL["risk"]


def pair_auc(rows: str, by: str = "", score: str = "risk", label: str = "y_fail") -> str:
    """AUC as the share of (positive, negative) pairs in the right order."""
    keys = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    return (f"SELECT {keys}sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0) AS auc, "
            f"CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM ("
            f"SELECT {keys}pos, neg, sum(neg) OVER ({'PARTITION BY ' + by if by else ''} ORDER BY score) - neg AS below FROM ("
            f"SELECT {keys}{score} AS score, sum({label}) AS pos, sum(1 - {label}) AS neg FROM {rows} GROUP BY {keys}{score})){tail}")


def folds_sql(n_test: str = "0.2", group: str = "instance_id", rows: str = "risk") -> str:
    return f"""
ranked_groups AS (
  SELECT {group}, row_number() OVER (ORDER BY md5(concat('42|', {group})), {group}) AS place, count(*) OVER () AS total
  FROM (SELECT DISTINCT {group} FROM {rows})),
sized AS (SELECT *, CAST(ceil(total * {n_test}) AS BIGINT) AS n_test FROM ranked_groups),
folds AS (
  SELECT {group}, CASE WHEN place <= n_test THEN 'test'
    WHEN place <= n_test + CAST(ceil((total - n_test) * 0.2) AS BIGINT) THEN 'val' ELSE 'train' END AS fold FROM sized)"""


@query("first_alert_overview", RISK + """,
per AS (
  SELECT trajectory_id, max(y_fail) AS y, max(n_total_steps) AS n, min(prefix_step) FILTER (risk >= 0.6) AS first FROM risk GROUP BY 1)
SELECT CAST(0.6 AS DOUBLE) AS threshold, count(*) FILTER (y = 1) AS n_failed, count(*) FILTER (y = 0) AS n_success,
  count(first) FILTER (y = 1) AS failed_alerted, count(first) FILTER (y = 0) AS success_false_alarmed,
  round(count(first) FILTER (y = 1) / greatest(1, count(*) FILTER (y = 1)), 6) AS failed_coverage,
  round(count(first) FILTER (y = 0) / greatest(1, count(*) FILTER (y = 0)), 6) AS success_false_alarm_rate,
  round(coalesce(median(n - first) FILTER (y = 1), 0), 6) AS median_lead_steps,
  round(coalesce(median((n - first) / n) FILTER (y = 1), 0), 6) AS median_lead_fraction FROM per""")
def first_alert_overview(spark, sf):
    return rounded(AL.first_alert_metrics(S.risk(spark, sf), 0.6))


@query("first_alerts_per_run", RISK + """
SELECT trajectory_id, max(y_fail) AS y_fail, max(n_total_steps) AS n_total_steps,
  min(prefix_step) FILTER (risk >= 0.6) AS first_alarm_step,
  max(n_total_steps) - min(prefix_step) FILTER (risk >= 0.6) AS lead_steps,
  round((max(n_total_steps) - min(prefix_step) FILTER (risk >= 0.6)) / max(n_total_steps), 6) AS lead_fraction
FROM risk GROUP BY 1""")
def first_alerts_per_run(spark, sf):
    return rounded(AL.first_alerts(S.risk(spark, sf), 0.6).drop("threshold"))


@query("lead_time_table", RISK + """,
per AS (SELECT trajectory_id, max(n_total_steps) AS n_total_steps, max(y_fail) AS y, min(prefix_step) FILTER (risk >= 0.6) AS first_alarm_step FROM risk GROUP BY 1)
SELECT trajectory_id, n_total_steps, first_alarm_step, n_total_steps - first_alarm_step AS lead_steps,
  round((n_total_steps - first_alarm_step) / n_total_steps, 6) AS lead_fraction FROM per WHERE y = 1 AND first_alarm_step IS NOT NULL""")
def lead_time_table(spark, sf):
    return rounded(AL.lead_times(S.risk(spark, sf), 0.6))


@query("roc_auc", RISK + """
SELECT round(avg(CASE WHEN p.risk > q.risk THEN 1.0 WHEN p.risk = q.risk THEN 0.5 ELSE 0.0 END), 6) AS auc,
  (SELECT count(*) FROM risk WHERE y_fail = 1) AS n_pos, (SELECT count(*) FROM risk WHERE y_fail = 0) AS n_neg
FROM risk p JOIN risk q ON p.y_fail = 1 AND q.y_fail = 0""")
def roc_auc(spark, sf):
    return rounded(M.roc_auc(S.risk(spark, sf)))


@query("roc_auc_by_model", RISK + """
SELECT model_name, round(auc, 6) AS auc, n_pos, n_neg FROM (""" + pair_auc("risk", "model_name") + ")")
def roc_auc_by_model(spark, sf):
    return rounded(M.roc_auc(S.risk(spark, sf), by=["model_name"]))


@query("average_rank", RISK + """
SELECT DISTINCT risk, rank() OVER (ORDER BY risk) + (count(*) OVER (PARTITION BY risk) - 1) / 2.0 AS avg_rank FROM risk""")
def average_rank(spark, sf):
    return M.average_rank(S.risk(spark, sf), "risk", "avg_rank")


_CURVE = """
curve AS (
  SELECT risk, sum(y_fail) AS pos, sum(1 - y_fail) AS neg FROM risk GROUP BY risk),
cum AS (SELECT *, sum(pos) OVER (ORDER BY risk DESC) AS tp, sum(neg) OVER (ORDER BY risk DESC) AS fp,
  sum(pos) OVER () AS n_pos, sum(neg) OVER () AS n_neg, count(*) OVER () AS n FROM curve)"""


@query("average_precision", RISK + "," + _CURVE + """
SELECT round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS average_precision FROM cum""")
def average_precision(spark, sf):
    return rounded(M.average_precision(S.risk(spark, sf)))


_BIN = "CASE " + " ".join(f"WHEN risk >= {e!r}::DOUBLE THEN {i}" for i, e in reversed(list(enumerate(M.BIN_EDGES, 1)))) + " ELSE 0 END"


@query("reliability_curve", RISK + f"""
SELECT CAST({_BIN} AS BIGINT) AS bin, round(avg(risk), 6) AS mean_predicted, round(avg(y_fail), 6) AS observed_freq, count(*) AS count
FROM risk GROUP BY 1""")
def reliability_curve(spark, sf):
    return rounded(M.reliability(S.risk(spark, sf)))


_ECE = f"""
bins AS (SELECT {{by}}{_BIN} AS bin, avg(risk) AS conf, avg(y_fail) AS acc, count(*) AS c FROM {{rows}} GROUP BY ALL),
ece AS (SELECT {{by}}sum(c * abs(conf - acc)) / sum(c) AS ece FROM bins GROUP BY ALL)"""


@query("metric_bundle_by_model", RISK + "," + _ECE.format(by="model_name, ", rows="risk") + """,
auc AS (""" + pair_auc("risk", "model_name") + """),
ap AS (
  SELECT model_name, sum(pos * tp / (tp + fp)) / sum(pos) AS ap FROM (
    SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM (
      SELECT model_name, risk, sum(y_fail) AS pos, sum(1 - y_fail) AS neg FROM risk GROUP BY ALL)
    WINDOW w AS (PARTITION BY model_name ORDER BY risk DESC)) GROUP BY 1)
SELECT model_name, count(*) AS n, round(avg(y_fail), 6) AS pos_rate, round(any_value(auc), 6) AS roc_auc,
  round(any_value(ap), 6) AS auprc, round(avg((risk - y_fail) * (risk - y_fail)), 6) AS brier, round(any_value(ece), 6) AS ece
FROM risk JOIN auc USING (model_name) JOIN ap USING (model_name) JOIN ece USING (model_name) GROUP BY 1""")
def metric_bundle_by_model(spark, sf):
    return rounded(M.metric_bundle(cut_lineage(S.risk(spark, sf)), by=["model_name"]))


@query("metric_bundle_single_class", RISK + "," + _ECE.format(by="y_fail, ", rows="risk") + """
SELECT y_fail, count(*) AS n, CAST(avg(y_fail) AS DOUBLE) AS pos_rate, CAST(NULL AS DOUBLE) AS roc_auc, CAST(NULL AS DOUBLE) AS auprc,
  round(avg((risk - y_fail) * (risk - y_fail)), 6) AS brier, round(any_value(ece), 6) AS ece
FROM risk JOIN ece USING (y_fail) GROUP BY 1""")
def metric_bundle_single_class(spark, sf):
    r = cut_lineage(S.risk(spark, sf)).withColumn("label", F.col("y_fail"))
    return rounded(M.metric_bundle(r, label="label", by=["y_fail"]))


@query("precision_at_false_alarm_rate", RISK + "," + _CURVE + """
SELECT far, threshold, round(tp / (tp + fp), 6) AS precision, round(tp / n_pos, 6) AS recall, round(fp / n_neg, 6) AS fpr_actual
FROM (SELECT CAST(far AS DOUBLE) AS far, arg_min(c, risk) AS b FROM cum c, (VALUES (0.05), (0.10), (0.20)) f(far)
      WHERE fp <= far * n_neg GROUP BY 1) x,
  LATERAL (SELECT b.risk AS threshold, b.tp AS tp, b.fp AS fp, b.n_pos AS n_pos, b.n_neg AS n_neg)""")
def precision_at_false_alarm_rate(spark, sf):
    r = cut_lineage(S.risk(spark, sf))
    out = None
    for far in (0.05, 0.10, 0.20):
        one = M.at_false_alarm_rate(r, far)
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query("pr_curve_points", RISK + "," + _CURVE + """,
p AS (SELECT row_number() OVER (ORDER BY risk) AS point, tp / (tp + fp) AS precision, tp / n_pos AS recall, n FROM cum
  UNION ALL SELECT DISTINCT n + 1, 1.0, 0.0, n FROM cum)
SELECT point, round(precision, 6) AS precision, round(recall, 6) AS recall FROM p
WHERE (point - 1) % greatest(1, (n + 1) // 20) = 0""")
def pr_curve_points(spark, sf):
    return rounded(M.pr_curve(cut_lineage(S.risk(spark, sf)), points=20))


_CANDIDATES = """
few AS (SELECT DISTINCT risk AS t FROM {rows}),
candidates AS (
  SELECT DISTINCT t FROM (
    SELECT t FROM few WHERE (SELECT count(*) FROM few) <= {n}
    UNION ALL SELECT unnest(quantile_cont(risk, {q})) FROM {rows} WHERE (SELECT count(*) FROM few) > {n}))"""


def candidates_sql(rows: str, n: int = 200) -> str:
    return _CANDIDATES.format(rows=rows, n=n, q="[" + ", ".join(repr(i / (n - 1)) for i in range(n)) + "]")


@query("candidate_thresholds", RISK + "," + candidates_sql("risk") + " SELECT round(t, 6) AS threshold FROM candidates")
def candidate_thresholds(spark, sf):
    return rounded(AL.candidate_thresholds(cut_lineage(S.risk(spark, sf))))


@query("candidate_threshold_grid", RISK + "," + candidates_sql("risk", 20) + " SELECT DISTINCT round(t, 6) AS threshold FROM candidates")
def candidate_threshold_grid(spark, sf):
    return rounded(AL.candidate_thresholds(cut_lineage(S.risk(spark, sf)), n_grid=20))


_THRESHOLDS = """
f1 AS (
  SELECT t, 2.0 * sum(y_fail) FILTER (risk >= t) / nullif(count(*) FILTER (risk >= t) + sum(y_fail), 0) AS f1
  FROM {rows} CROSS JOIN candidates GROUP BY t),
tops AS (SELECT trajectory_id, max(risk) AS top FROM {rows} WHERE y_fail = 0 GROUP BY 1),
far AS (SELECT t, count(*) FILTER (top >= t) / greatest(1, count(top)) AS far FROM candidates LEFT JOIN tops ON true GROUP BY t),
thresholds AS (
  SELECT 'T1_max_f1' AS policy, coalesce((SELECT t FROM f1 ORDER BY coalesce(f1, 0) DESC, t LIMIT 1), 0.5) AS threshold
  UNION ALL SELECT 'T2_success_far_lte_20pct', coalesce((SELECT min(t) FROM far WHERE far <= 0.2), 1.0)
  UNION ALL SELECT 'T3_success_far_lte_10pct', coalesce((SELECT min(t) FROM far WHERE far <= 0.1), 1.0)
  UNION ALL SELECT 'T4_success_far_lte_5pct', coalesce((SELECT min(t) FROM far WHERE far <= 0.05), 1.0))"""


@query("threshold_policies", RISK + "," + candidates_sql("risk") + "," + _THRESHOLDS.format(rows="risk") + """
SELECT policy, round(threshold, 6) AS threshold FROM thresholds""")
def threshold_policies(spark, sf):
    return rounded(AL.select_thresholds(cut_lineage(S.risk(spark, sf))))


_TRADEOFF = RISK + "," + folds_sql() + """,
val AS (SELECT r.* FROM risk r JOIN folds USING (instance_id) WHERE fold = 'val'),
test AS (SELECT r.* FROM risk r JOIN folds USING (instance_id) WHERE fold = 'test'),""" + candidates_sql("val") + "," + _THRESHOLDS.format(rows="val") + """,
per AS (SELECT policy, threshold, trajectory_id, max(y_fail) AS y, max(n_total_steps) AS n, min(prefix_step) FILTER (risk >= threshold) AS first
  FROM test CROSS JOIN thresholds GROUP BY ALL)
SELECT policy AS threshold_policy, round(threshold, 6) AS threshold,
  round(count(first) FILTER (y = 0) / greatest(1, count(*) FILTER (y = 0)), 6) AS success_false_alarm_rate,
  round(count(first) FILTER (y = 1) / greatest(1, count(*) FILTER (y = 1)), 6) AS failed_alert_rate,
  round(coalesce(median(n - first) FILTER (y = 1), 0), 6) AS median_lead_steps
FROM per GROUP BY ALL"""


@query("threshold_tradeoff_table", _TRADEOFF)
def threshold_tradeoff_table(spark, sf):
    """Thresholds chosen on validation, first-alert metrics on test."""
    r = cut_lineage(SP.split(cut_lineage(S.risk(spark, sf))))
    cuts = AL.select_thresholds(r.where("fold = 'val'"))
    out = AL.first_alert_metrics(r.where("fold = 'test'"), cuts, by=["policy"])
    return rounded(out.select(
        F.col("policy").alias("threshold_policy"), "threshold", "success_false_alarm_rate",
        F.col("failed_coverage").alias("failed_alert_rate"), "median_lead_steps"))


# ---------------------------------------------------------------- position


@query("risk_by_position", RISK + """
SELECT y_fail, CAST(least(floor(prefix_step / n_total_steps * 10), 9) AS BIGINT) AS bin,
  round((least(floor(prefix_step / n_total_steps * 10), 9) + 0.5) / 10, 6) AS pos_center,
  round(avg(risk), 6) AS mean_risk, count(*) AS n FROM risk GROUP BY ALL""")
def risk_by_position(spark, sf):
    return rounded(position_profile(S.risk(spark, sf)))


_STRATA = """,
strata AS (SELECT *, CASE WHEN prefix_step / n_total_steps <= 0.33 THEN 'early'
  WHEN prefix_step / n_total_steps <= 0.66 THEN 'mid' ELSE 'late' END AS stratum FROM risk),
both_strata AS (SELECT stratum, risk, y_fail FROM strata UNION ALL SELECT 'overall', risk, y_fail FROM strata)"""


@query("auc_by_position_stratum", RISK + _STRATA + " SELECT stratum, round(auc, 6) AS auc, n_pos, n_neg FROM ("
       + pair_auc("both_strata", "stratum") + ")")
def auc_by_position_stratum(spark, sf):
    return rounded(position_strata_auc(S.risk(spark, sf)))


# ---------------------------------------------------------------- resampling


_DRAWS = """
numbers AS (SELECT {g} AS g, row_number() OVER (ORDER BY md5(CAST({g} AS VARCHAR)), {g}) - 1 AS no, count(*) OVER () AS total
  FROM (SELECT DISTINCT {g} FROM {rows})),
draws AS (
  SELECT id // total AS replicate, CAST(('0x' || substr(md5(concat({seed}, '|', id)), 1, 8)) AS BIGINT) % total AS no
  FROM (SELECT DISTINCT total FROM numbers), LATERAL (SELECT unnest(range({b} * total)) AS id)),
times AS (SELECT replicate, g, count(*) AS times FROM draws JOIN numbers USING (no) GROUP BY ALL)"""


def draws_sql(rows: str, group: str, b: int, seed: int) -> str:
    return _DRAWS.format(rows=rows, g=group, b=b, seed=seed)


def weighted_auc_sql(score: str) -> str:
    return f"""SELECT replicate, sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0) AS value FROM (
    SELECT *, sum(neg) OVER (PARTITION BY replicate ORDER BY s) - neg AS below FROM (
      SELECT replicate, {score} AS s, sum(times * y_fail) AS pos, sum(times * (1 - y_fail)) AS neg
      FROM risk JOIN times ON instance_id = g GROUP BY ALL)) GROUP BY 1"""


@query("bootstrap_auc_interval", RISK + "," + draws_sql("risk", "instance_id", 500, 42) + f""",
reps AS ({weighted_auc_sql('risk')})
SELECT round((SELECT auc FROM ({pair_auc('risk')})), 6) AS point, round(quantile_cont(value, 0.025), 6) AS lo,
  round(quantile_cont(value, 0.975), 6) AS hi, count(value) AS n_boot FROM reps""")
def bootstrap_auc_interval(spark, sf):
    return rounded(RS.bootstrap_interval(cut_lineage(S.risk(spark, sf))))


@query("bootstrap_precision_interval", RISK + "," + draws_sql("risk", "instance_id", 500, 42) + """,
reps AS (
  SELECT replicate, CASE WHEN sum(neg) > 0 THEN sum(CASE WHEN pos > 0 THEN pos * tp / (tp + fp) ELSE 0 END) / nullif(sum(pos), 0) END AS value FROM (
    SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM (
      SELECT replicate, risk, sum(times * y_fail) AS pos, sum(times * (1 - y_fail)) AS neg FROM risk JOIN times ON instance_id = g GROUP BY ALL)
    WINDOW w AS (PARTITION BY replicate ORDER BY risk DESC)) GROUP BY 1),""" + _CURVE + """
SELECT round((SELECT sum(pos * tp / (tp + fp)) / sum(pos) FROM cum), 6) AS point, round(quantile_cont(value, 0.025), 6) AS lo,
  round(quantile_cont(value, 0.975), 6) AS hi, count(value) AS n_boot FROM reps""")
def bootstrap_precision_interval(spark, sf):
    return rounded(RS.bootstrap_interval(cut_lineage(S.risk(spark, sf)), "average_precision"))


_SECOND = "round(risk * 0.7 + (prefix_step % 7) * 0.04, 6)"


@query("paired_bootstrap_delta", RISK + "," + draws_sql("risk", "instance_id", 1000, 42) + f""",
scored AS (SELECT *, {_SECOND} AS risk_new FROM risk),
b AS ({weighted_auc_sql('risk')}), n AS ({weighted_auc_sql(_SECOND)}),
d AS (SELECT b.value AS vb, n.value AS vn FROM b JOIN n USING (replicate) WHERE b.value IS NOT NULL),
p AS (SELECT (SELECT auc FROM ({pair_auc('scored')})) AS pb, (SELECT auc FROM ({pair_auc('scored', score='risk_new')})) AS pn)
SELECT round(pb, 4) AS auc_base, round(pn, 4) AS auc_new, round(pn - pb, 4) AS delta,
  round(quantile_cont(vn - vb, 0.025), 4) AS delta_lo, round(quantile_cont(vn - vb, 0.975), 4) AS delta_hi,
  round(count(*) FILTER (vn > vb) / count(*), 3) AS frac_new_better,
  CAST(quantile_cont(vn - vb, 0.025) > 0 AS BIGINT) AS significant, CAST(quantile_cont(vn - vb, 0.975) < 0 AS BIGINT) AS significant_loss,
  count(*) AS n_boot FROM d, p GROUP BY pb, pn""")
def paired_bootstrap_delta(spark, sf):
    r = cut_lineage(S.risk(spark, sf)).withColumn("risk_new", F.round(F.col("risk") * 0.7 + (F.col("prefix_step") % 7) * 0.04, 6))
    return RS.paired_auc_delta(r, "risk", "risk_new")


@query("mean_bootstrap_interval", "WITH " + draws_sql("customer", "c_custkey", 2000, 0) + """,
reps AS (SELECT replicate, sum(c_acctbal * times) / sum(times) AS value FROM customer JOIN times ON c_custkey = g GROUP BY 1)
SELECT round((SELECT avg(c_acctbal) FROM customer), 6) AS mean, (SELECT count(*) FROM customer) AS n,
  round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.975), 6) AS hi, count(value) AS n_boot FROM reps""")
def mean_bootstrap_interval(spark, sf):
    c = S.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return rounded(RS.mean_interval(c, "c_acctbal", "c_custkey"))


# ---------------------------------------------------------------- abstention


@query("commit_decisions", RISK + """
SELECT prefix_id, round(abs(risk - 0.5), 6) AS confidence, CAST(prefix_step >= 10 AND abs(risk - 0.5) >= 0.1 AS BIGINT) AS committed FROM risk""")
def commit_decisions(spark, sf):
    r = S.risk(spark, sf)
    return rounded(r.select("prefix_id", AB.confidence(F.col("risk")).alias("confidence"),
                            AB.committed(F.col("prefix_step"), F.col("risk"), 10, 0.1).cast("bigint").alias("committed")))


_COVERAGES = "(VALUES " + ", ".join(f"({c!r}::DOUBLE)" for c in AB.COVERAGES) + ") c(cov)"
_KEPT = f"(SELECT DISTINCT greatest(1, CAST(round_even(cov * (SELECT count(*) FROM risk), 0) AS BIGINT)) AS k FROM {_COVERAGES})"


@query("risk_coverage_selective", RISK + f""",
ranked AS (SELECT risk, y_fail, row_number() OVER (ORDER BY abs(risk - 0.5) DESC, prefix_id) AS rn FROM risk),
kept AS (SELECT k, risk, y_fail FROM ranked JOIN {_KEPT} ON rn <= k)
SELECT round(k / (SELECT count(*) FROM risk), 6) AS coverage, round(auc, 6) AS auc, k AS n FROM ({pair_auc('kept', 'k')}) WHERE auc IS NOT NULL""")
def risk_coverage_selective(spark, sf):
    return rounded(AB.selective_curve(cut_lineage(S.risk(spark, sf))))


@query("risk_coverage_random", RISK + f""",
ranked AS (SELECT rep, risk, y_fail, row_number() OVER (PARTITION BY rep ORDER BY md5(concat('42|', rep, '|', prefix_id)), prefix_id) AS rn
  FROM risk, (VALUES (0), (1), (2), (3), (4)) r(rep)),
kept AS (SELECT k, rep, risk, y_fail, concat(k, '/', rep) AS g FROM ranked JOIN {_KEPT} ON rn <= k)
SELECT round(k / (SELECT count(*) FROM risk), 6) AS coverage, round(avg(auc), 6) AS auc, k AS n
FROM (SELECT *, CAST(split_part(g, '/', 1) AS BIGINT) AS k FROM ({pair_auc('kept', 'g')})) WHERE auc IS NOT NULL GROUP BY k""")
def risk_coverage_random(spark, sf):
    return rounded(AB.random_curve(cut_lineage(S.risk(spark, sf)), repeats=5))


@query("risk_coverage_step_gate", RISK + """,
gated AS (SELECT CAST(f AS BIGINT) AS step_floor, risk, y_fail FROM risk JOIN (VALUES (0), (3), (5), (8), (10), (15), (20), (25), (30)) v(f) ON prefix_step >= f)
SELECT step_floor, round((n_pos + n_neg) / (SELECT count(*) FROM risk), 6) AS coverage, round(auc, 6) AS auc, n_pos + n_neg AS n
FROM (""" + pair_auc("gated", "step_floor") + ") WHERE n_pos + n_neg >= 50 AND auc IS NOT NULL")
def risk_coverage_step_gate(spark, sf):
    return rounded(AB.step_gate_curve(S.risk(spark, sf)))


@query("abstention_operating_point", RISK + "," + folds_sql() + """,
gate AS (SELECT coalesce(median(abs(risk - 0.5)), 0) AS cf FROM risk JOIN folds USING (instance_id) WHERE fold = 'val' AND prefix_step >= 10),
test AS (SELECT r.* FROM risk r JOIN folds USING (instance_id) WHERE fold = 'test'),
kept AS (SELECT test.* FROM test, gate WHERE prefix_step >= 10 AND abs(risk - 0.5) >= cf),
cum AS (SELECT *, sum(pos) OVER (ORDER BY risk DESC) AS tp, sum(neg) OVER (ORDER BY risk DESC) AS fp, sum(pos) OVER () AS n_pos, sum(neg) OVER () AS n_neg
  FROM (SELECT risk, sum(y_fail) AS pos, sum(1 - y_fail) AS neg FROM kept GROUP BY risk)),
best AS (SELECT arg_min(c, risk) AS b FROM cum c WHERE fp <= 0.1 * n_neg)
SELECT CAST(10 AS BIGINT) AS step_floor, round(cf, 6) AS conf_floor, round((SELECT count(*) FROM kept) / (SELECT count(*) FROM test), 6) AS test_coverage,
  CASE WHEN (SELECT count(*) FROM kept) > 50 THEN round((SELECT auc FROM (""" + pair_auc("kept") + """)), 6) END AS test_auc,
  CASE WHEN (SELECT min(n_pos * n_neg) FROM cum) > 0 THEN round(coalesce(b.tp / (b.tp + b.fp), 0), 6) END AS precision_at_far,
  CASE WHEN (SELECT min(n_pos * n_neg) FROM cum) > 0 THEN round(coalesce(b.tp / b.n_pos, 0), 6) END AS recall_at_far FROM gate, best""")
def abstention_operating_point(spark, sf):
    r = cut_lineage(SP.split(cut_lineage(S.risk(spark, sf))))
    return rounded(AB.operating_point(r.where("fold = 'val'"), r.where("fold = 'test'")))


# ---------------------------------------------------------------- samples


@query("sample_stratified_runs", "WITH " + S.SQL["events"] + """,
chosen AS (SELECT instance_id FROM (SELECT DISTINCT instance_id FROM runs) ORDER BY md5(concat('42|', instance_id)), instance_id LIMIT 30),
r AS (SELECT runs.*, row_number() OVER (PARTITION BY instance_id, y_fail ORDER BY md5(concat('42|', trajectory_id)), trajectory_id) AS rn
  FROM runs JOIN chosen USING (instance_id))
SELECT trajectory_id, instance_id, model_name, n_total_steps, y_fail FROM r WHERE rn <= CASE WHEN y_fail = 1 THEN 2 ELSE 1 END""")
def sample_stratified_runs(spark, sf):
    return SA.stratified(S.runs(S.event_log(spark, sf)), "instance_id", "y_fail", 2, 1, ["trajectory_id"], max_groups=30)


@query("sample_train_enrichment", "WITH " + S.SQL["events"] + "," + folds_sql(rows="runs") + """,
r AS (SELECT runs.*, row_number() OVER (PARTITION BY instance_id, y_fail ORDER BY md5(concat('42|', trajectory_id)), trajectory_id) AS rn
  FROM runs WHERE instance_id IN (SELECT instance_id FROM folds WHERE fold = 'train'))
SELECT trajectory_id, instance_id, model_name, n_total_steps, y_fail FROM r WHERE rn <= CASE WHEN y_fail = 1 THEN 10 ELSE 1 END""")
def sample_train_enrichment(spark, sf):
    """More failed runs for the training instances only; the other folds stay as they are."""
    runs = S.runs(S.event_log(spark, sf))
    train = SP.grouped_folds(runs).where("fold = 'train'")
    return SA.stratified(runs, "instance_id", "y_fail", 10, 1, ["trajectory_id"], allowed=train)


@query("sample_balanced_prefixes", RISK + """,
pool AS (SELECT * FROM risk WHERE prefix_step BETWEEN 5 AND 40),
p AS (SELECT prefix_id, y_fail FROM pool WHERE y_fail = 1 ORDER BY md5(concat('42|', prefix_id)), prefix_id LIMIT 60),
n AS (SELECT prefix_id, y_fail, row_number() OVER (ORDER BY md5(concat('42|', prefix_id)), prefix_id) AS rn FROM pool WHERE y_fail = 0)
SELECT * FROM p UNION ALL SELECT prefix_id, y_fail FROM n WHERE rn <= 120 - (SELECT count(*) FROM p)""")
def sample_balanced_prefixes(spark, sf):
    pool = S.risk(spark, sf).where("prefix_step BETWEEN 5 AND 40")
    return SA.balanced(pool.select("prefix_id", "y_fail"), 120)


@query("shuffle_order", RISK + """
SELECT prefix_id, row_number() OVER (ORDER BY md5(concat('42|', prefix_id)), prefix_id) AS shuffle_no FROM risk""")
def shuffle_order(spark, sf):
    return SA.shuffled(S.risk(spark, sf).select("prefix_id"), "prefix_id")


@query("half_split", RISK + """
SELECT prefix_id, CAST(row_number() OVER (ORDER BY md5(concat('42|', prefix_id)), prefix_id) <= count(*) OVER () // 2 AS BIGINT) AS first_half FROM risk""")
def half_split(spark, sf):
    return SA.half(S.risk(spark, sf).select("prefix_id"), "prefix_id")


@query("one_prefix_per_run", RISK + """
SELECT trajectory_id, arg_max(prefix_id, (risk, prefix_step)) AS riskiest, arg_max(prefix_id, prefix_step) AS latest FROM risk GROUP BY 1""")
def one_prefix_per_run(spark, sf):
    r = S.risk(spark, sf).select("trajectory_id", "prefix_id", "risk", "prefix_step")
    a = SA.one_per_run(r, [F.col("risk"), F.col("prefix_step")]).select("trajectory_id", F.col("prefix_id").alias("riskiest"))
    b = SA.one_per_run(r, [F.col("prefix_step")]).select("trajectory_id", F.col("prefix_id").alias("latest"))
    return a.join(b, "trajectory_id")


@query("one_run_per_instance", "WITH " + S.SQL["events"] + """
SELECT instance_id, trajectory_id, n_total_steps FROM runs
QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY n_total_steps DESC, trajectory_id) = 1""")
def one_run_per_instance(spark, sf):
    runs = S.runs(S.event_log(spark, sf)).select("instance_id", "trajectory_id", "n_total_steps")
    return SA.deduplicated(runs, "instance_id", [F.col("n_total_steps").desc(), F.col("trajectory_id")])


@query("top_risk_prefixes", RISK + " SELECT prefix_id, trajectory_id, prefix_step, y_fail, risk FROM risk ORDER BY risk DESC, prefix_id LIMIT 25")
def top_risk_prefixes(spark, sf):
    return SA.top_by_risk(S.risk(spark, sf).select("prefix_id", "trajectory_id", "prefix_step", "y_fail", "risk"), 25)


@query("random_instance_subsets", "WITH " + S.SQL["events"] + """
SELECT rep, instance_id FROM (SELECT DISTINCT instance_id FROM runs), (SELECT unnest(range(5)) AS rep)
QUALIFY row_number() OVER (PARTITION BY rep ORDER BY md5(concat('0|', rep, '|', instance_id)), instance_id) <= 12""")
def random_instance_subsets(spark, sf):
    return SA.subsets(S.runs(S.event_log(spark, sf)), "instance_id", 12, 5)


# ---------------------------------------------------------------- splits


@query("split_by_instance", RISK + "," + folds_sql() + " SELECT prefix_id, instance_id, fold FROM risk JOIN folds USING (instance_id)")
def split_by_instance(spark, sf):
    return SP.split(S.risk(spark, sf)).select("prefix_id", "instance_id", "fold")


_REPO = RISK + ", repos AS (SELECT *, regexp_replace(instance_id, '-[^-]*$', '') AS repo FROM risk)," + folds_sql(group="repo", rows="repos")


@query("split_by_repo", _REPO + " SELECT prefix_id, repo, fold FROM repos JOIN folds USING (repo)")
def split_by_repo(spark, sf):
    return SP.split(S.risk(spark, sf), "repo").select("prefix_id", "repo", "fold")


@query("split_by_model", RISK + """,
m AS (SELECT model_name, row_number() OVER (ORDER BY md5(concat('42|', model_name)), model_name) AS place, count(*) OVER () AS total
  FROM (SELECT DISTINCT model_name FROM risk)),
held AS (SELECT model_name FROM m WHERE place <= greatest(1, total // 3)),
rest AS (SELECT * FROM risk WHERE model_name NOT IN (SELECT model_name FROM held)),
g AS (SELECT instance_id, row_number() OVER (ORDER BY md5(concat('42|', instance_id)), instance_id) AS place, count(*) OVER () AS total
  FROM (SELECT DISTINCT instance_id FROM rest))
SELECT prefix_id, 'test' AS fold FROM risk WHERE model_name IN (SELECT model_name FROM held)
UNION ALL SELECT prefix_id, CASE WHEN place <= ceil(total * 0.2) THEN 'val' ELSE 'train' END FROM rest JOIN g USING (instance_id)""")
def split_by_model(spark, sf):
    return SP.split(cut_lineage(S.risk(spark, sf)), "model").select("prefix_id", "fold")


@query("split_summary", RISK + "," + folds_sql() + """
SELECT fold, count(*) AS n_rows, count(DISTINCT instance_id) AS n_groups, round(avg(y_fail), 6) AS fail_rate
FROM risk JOIN folds USING (instance_id) GROUP BY fold""")
def split_summary(spark, sf):
    return rounded(SP.summary(SP.split(S.risk(spark, sf))))


@query("split_overlap_check", RISK + "," + folds_sql() + """
SELECT count(*) AS n_groups, count(*) FILTER (n_folds > 1) AS n_shared
FROM (SELECT instance_id, count(DISTINCT fold) AS n_folds FROM risk JOIN folds USING (instance_id) GROUP BY 1)""")
def split_overlap_check(spark, sf):
    return SP.overlap(SP.split(S.risk(spark, sf)))


def kfold_sql(name: str, sizes: str, group: str, k: int) -> str:
    """CTE (group, fold): groups from large to small to the lightest fold; equal sizes dealt by hash."""
    return f"""{name} AS (
  WITH RECURSIVE o AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS i FROM {sizes}),
  r AS (
    SELECT CAST(0 AS BIGINT) AS i, CAST({[0] * k} AS BIGINT[]) AS loads, CAST(0 AS BIGINT) AS fold, CAST(0 AS BIGINT) AS n
    UNION ALL
    SELECT o.i, list_transform(loads, lambda x, j: x + CASE WHEN j = list_position(loads, list_min(loads)) THEN o.n ELSE 0 END),
           list_position(loads, list_min(loads)) - 1, o.n FROM r JOIN o ON o.i = r.i + 1),
  c AS (SELECT n, fold, count(*) AS c FROM r WHERE i > 0 GROUP BY ALL),
  span AS (SELECT n, fold, c, sum(c) OVER (PARTITION BY n ORDER BY fold) AS upto FROM c),
  ranks AS (SELECT {group}, n, row_number() OVER (PARTITION BY n ORDER BY md5(concat('0|', {group})), {group}) AS place FROM {sizes})
  SELECT {group}, fold FROM ranks JOIN span USING (n) WHERE place > upto - c AND place <= upto)"""


@query("group_kfold", RISK + """,
s AS (SELECT instance_id, count(*) AS n FROM risk GROUP BY 1),""" + kfold_sql("f", "s", "instance_id", 5) + """
SELECT instance_id, fold FROM f""")
def group_kfold(spark, sf):
    return SP.group_kfold(S.risk(spark, sf))


@query("cross_model_roles", RISK + """,
src AS (SELECT *, CASE WHEN CAST(substr(trajectory_id, 2) AS BIGINT) % 10 < 2 THEN concat('shared', CAST(substr(trajectory_id, 2) AS BIGINT) // 10)
  ELSE concat('own', CAST(substr(trajectory_id, 2) AS BIGINT)) END AS inst FROM risk),
target AS (SELECT * FROM src WHERE model_name <> 'm0'),
pool AS (SELECT * FROM src WHERE model_name = 'm0' AND inst NOT IN (SELECT inst FROM target)),
g AS (SELECT inst, row_number() OVER (ORDER BY md5(concat('42|', inst)), inst) AS place, count(*) OVER () AS total FROM (SELECT DISTINCT inst FROM pool))
SELECT prefix_id, 'target' AS role FROM target
UNION ALL SELECT prefix_id, CASE WHEN place <= floor(total * 0.85) THEN 'train' ELSE 'holdout' END FROM pool JOIN g USING (inst)""")
def cross_model_roles(spark, sf):
    return SP.transfer_roles(part_shared_instances(cut_lineage(S.risk(spark, sf))), "m0").select("prefix_id", "role")


def part_shared_instances(r):
    """Instances of which some are shared by runs of two models and most belong to one run."""
    user = F.substring("trajectory_id", 2, 20).cast("bigint")
    return r.withColumn("instance_id", F.when(
        user % 10 < 2, F.concat(F.lit("shared"), F.floor(user / 10).cast("string"))).otherwise(
        F.concat(F.lit("own"), user.cast("string"))))


@query("fold_assignment_join", RISK + "," + folds_sql() + """
SELECT fold, count(*) AS n, round(avg(risk), 6) AS mean_risk FROM risk JOIN folds USING (instance_id) GROUP BY 1""")
def fold_assignment_join(spark, sf):
    r = S.risk(spark, sf)
    assigned = SP.split(r).select("prefix_id", "fold")
    return rounded(r.join(assigned, "prefix_id").groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.avg("risk").alias("mean_risk")))


@query("resume_pending_prefixes", RISK + """
SELECT prefix_id FROM risk WHERE CAST(('0x' || substr(md5(prefix_id), 1, 8)) AS BIGINT) % 3 <> 0""")
def resume_pending_prefixes(spark, sf):
    """Scoring that goes on where it stopped: ids already done are left out."""
    r = S.risk(spark, sf).select("prefix_id")
    done = r.where(T.hash_number(F.col("prefix_id")) % 3 == 0)
    return r.join(done, "prefix_id", "left_anti")
