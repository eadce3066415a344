"""Queries over vectors, samples per problem and domain shift."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailcast.operators import selection as SL
from trailcast.operators import shift as SH
from trailcast.operators import vectors as V
from trailcast.plans.evaluation import kfold_sql, RISK, pair_auc
from trailcast.plans.features import BASE_SQL, rounded
from trailcast.plans.decisions import prefixes
from trailcast.plans.registry import query
from trailcast.session import reuse
from trailcast.sources import standin as S


def contrast(spark, sf):
    """Vectors of two conditions with ``y`` = 1 for the first."""
    a = S.activations(spark, sf).where(F.col("cond").isin(0, 1))
    return a.withColumn("y", (F.col("cond") == 0).cast("bigint"))


_ACT = "WITH " + S.SQL["activations"] + """,
con AS (SELECT *, CAST(cond = 0 AS BIGINT) AS y FROM activations WHERE cond IN (0, 1)),
long AS (SELECT * EXCLUDE (vec), unnest(CAST(vec AS DOUBLE[])) AS v, generate_subscripts(vec, 1) - 1 AS dim FROM con)"""


@query("direction_of_means", _ACT + """
SELECT dim, round(avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0), 6) AS d FROM long GROUP BY 1""")
def direction_of_means(spark, sf):
    d = V.directions(contrast(spark, sf))
    return d.select(F.posexplode("direction").alias("dim", "d")).select(
        F.col("dim").cast("bigint").alias("dim"), F.round("d", 6).alias("d"))


_DIR = """,
dir AS (SELECT dim, avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0) AS d FROM long GROUP BY 1),
unit AS (SELECT dim, d / (sqrt(sum(d * d) OVER ()) + 1e-8) AS d FROM dir)"""


@query("direction_projections", _ACT + _DIR + """
SELECT vec_id, cond, round(sum(v * d), 6) AS projection FROM long JOIN unit USING (dim) GROUP BY ALL""")
def direction_projections(spark, sf):
    c = contrast(spark, sf)
    return rounded(V.project(c, V.directions(c, unit=True)).select("vec_id", "cond", "projection"))


def _held_sql(by: str, k: int = 4) -> str:
    """Held-out projections by brute force: train each fold's direction on the other folds."""
    keys = f"{by}, " if by else ""
    on = f"AND t.{by} = h.{by}" if by else ""
    return _ACT + f""",
sizes AS (SELECT grp, count(*) AS n FROM con GROUP BY 1),
{kfold_sql("fold", "sizes", "grp", k)},
lf AS (SELECT long.*, fold FROM long JOIN fold USING (grp)),
dirs AS (
  SELECT {keys.replace(by, 'h.' + by) if by else ''}h.fold, t.dim, avg(t.v) FILTER (t.y = 1) - avg(t.v) FILTER (t.y = 0) AS d
  FROM (SELECT DISTINCT {keys}fold FROM lf) h JOIN lf t ON t.fold <> h.fold {on} GROUP BY ALL),
held AS (SELECT {keys}fold, vec_id, y, len, round(sum(v * d), 9) AS p FROM lf JOIN dirs USING ({keys}fold, dim) GROUP BY ALL)"""


def _fold_auc(by: str) -> str:
    keys = f"{by}, " if by else ""
    key = f"concat({by}, '/', fold)" if by else "CAST(fold AS VARCHAR)"
    return f"(SELECT * FROM ({pair_auc(f'(SELECT {keys}fold, {key} AS g, p AS risk, y AS y_fail FROM held)', 'g')}))"


@query("probe_auc", _held_sql("") + f"""
SELECT round(avg(auc), 6) AS auc, round(stddev_pop(auc), 6) AS auc_sd FROM {_fold_auc('')}""")
def probe_auc(spark, sf):
    return rounded(V.probe_auc(contrast(spark, sf), k=4))


@query("probe_by_layer", _held_sql("layer") + f""",
a AS (SELECT CAST(split_part(g, '/', 1) AS BIGINT) AS layer, avg(auc) AS auc, stddev_pop(auc) AS auc_sd FROM {_fold_auc('layer')} GROUP BY 1),
c AS (SELECT layer, abs(corr(p, len)) AS len_corr FROM held GROUP BY 1),
l AS ({pair_auc('con', 'layer', score='len', label='y')})
SELECT layer, round(a.auc, 6) AS auc, round(auc_sd, 6) AS auc_sd, round(greatest(l.auc, 1 - l.auc), 6) AS length_only_auc, round(len_corr, 6) AS len_corr
FROM a JOIN c USING (layer) JOIN l USING (layer)""")
def probe_by_layer(spark, sf):
    c = contrast(spark, sf)
    return rounded(V.probe_auc(c, ["layer"], k=4).join(V.length_confound(c, ["layer"], k=4), "layer"))


@query("layer_sweep", _held_sql("layer", 5) + f""",
a AS (SELECT CAST(split_part(g, '/', 1) AS BIGINT) AS layer, avg(auc) AS auc FROM {_fold_auc('layer')} GROUP BY 1),
c AS (SELECT layer, abs(corr(p, len)) AS len_corr FROM held GROUP BY 1),
l AS ({pair_auc('con', 'layer', score='len', label='y')}),
per AS (
  SELECT layer, a.auc, len_corr, greatest(l.auc, 1 - l.auc) AS alone, (round(a.auc, 9), -layer) AS place
  FROM a JOIN c USING (layer) JOIN l USING (layer)),
best AS (
  SELECT max(alone) AS alone, arg_max(layer, place) AS p, arg_max(auc, place) AS p_auc, arg_max(len_corr, place) AS p_corr,
    coalesce(arg_max(layer, place) FILTER (len_corr < 0.5), p) AS c, coalesce(arg_max(auc, place) FILTER (len_corr < 0.5), p_auc) AS c_auc
  FROM per)
SELECT CAST(4 AS BIGINT) AS n_layers, round(alone, 6) AS length_only_auc, round(p_auc, 6) AS peak_auc, p AS peak_layer,
  round(p / 3.0, 6) AS peak_depth, round(p_corr, 6) AS len_corr_at_peak, round(c_auc, 6) AS clean_auc, c AS clean_layer,
  round(c / 3.0, 6) AS clean_depth FROM best""")
def layer_sweep(spark, sf):
    return rounded(V.layer_sweep(contrast(spark, sf), 4))


@query("axis_disentanglement", "WITH " + S.SQL["activations"] + """,
long AS (SELECT vec_id, cond, unnest(CAST(vec AS DOUBLE[])) AS v, generate_subscripts(vec, 1) - 1 AS dim FROM activations),
m AS (SELECT dim, avg(v) FILTER (cond = 0) - avg(v) FILTER (cond = 1) AS a, avg(v) FILTER (cond = 0) - avg(v) FILTER (cond = 2) AS b FROM long GROUP BY 1),
u AS (SELECT dim, a / (sqrt(sum(a * a) OVER ()) + 1e-8) AS a, b / (sqrt(sum(b * b) OVER ()) + 1e-8) AS b FROM m),
p AS (SELECT cond, avg(pa) AS pa, avg(pb) AS pb FROM (SELECT vec_id, cond, sum(v * a) AS pa, sum(v * b) AS pb FROM long JOIN u USING (dim) GROUP BY ALL) GROUP BY 1)
SELECT cond, round((SELECT abs(sum(a * b)) FROM u), 6) AS cosine, round(pa - (SELECT pa FROM p WHERE cond = 0), 6) AS on_a, round(pb - (SELECT pb FROM p WHERE cond = 0), 6) AS on_b FROM p""")
def axis_disentanglement(spark, sf):
    return rounded(V.cosine_and_projections(S.activations(spark, sf), 0, 1, 2))


@query("within_group_direction", _ACT + """,
g AS (SELECT grp, dim, avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0) AS d FROM long GROUP BY ALL)
SELECT dim, round(avg(d), 6) AS d FROM g WHERE d IS NOT NULL GROUP BY 1""")
def within_group_direction(spark, sf):
    return V.within_group_direction(contrast(spark, sf)).select(
        F.col("dim").cast("bigint").alias("dim"), F.round("d", 6).alias("d"))


@query("principal_plane")
def principal_plane(spark, sf):
    return V.principal_plane(S.activations(spark, sf)).select("vec_id", "cond", "x", "y2")


@query("class_separation")
def class_separation(spark, sf):
    return V.class_separation(reuse(V.principal_plane(S.activations(spark, sf))))


# ---------------------------------------------------------------- selection


_PROBLEMS = "WITH " + S.SQL["samples"] + """,
votes AS (SELECT problem_id, signature, count(*) AS n, min(k) AS first, arg_min(solved, k) AS fs FROM samples GROUP BY ALL),
majority AS (SELECT problem_id, arg_max(fs, (n, -first)) AS majority FROM votes GROUP BY 1),
problems AS (
  SELECT problem_id, any_value(difficulty) AS difficulty, count(*) AS n_samples, CAST(sum(solved) AS BIGINT) AS n_solve, avg(solved) AS pass1,
    max(solved) AS passk, arg_min(solved, k) AS greedy, arg_max(solved, (score, -k)) AS verifier, any_value(majority) AS majority
  FROM samples JOIN majority USING (problem_id) GROUP BY problem_id),
mixed AS (SELECT * FROM problems WHERE n_solve > 0 AND n_solve < n_samples)"""


@query("pass_at_k", _PROBLEMS + """
SELECT problem_id, difficulty, n_samples, n_solve, round(pass1, 6) AS pass1, passk, greedy, verifier, majority FROM problems""")
def pass_at_k(spark, sf):
    return rounded(SL.per_problem(S.samples(spark, sf)))


@query("reachable_greedy_failures", _PROBLEMS + """
SELECT difficulty, count(*) AS greedy_failures, CAST(sum(passk) AS BIGINT) AS reachable FROM problems WHERE greedy = 0 GROUP BY 1""")
def reachable_greedy_failures(spark, sf):
    return SL.reachability(SL.per_problem(S.samples(spark, sf)))


@query("selection_report", _PROBLEMS + """,
parts AS (SELECT 'all' AS part, * FROM mixed UNION ALL SELECT CASE WHEN greedy = 0 THEN 'held_out' ELSE 'train' END, * FROM mixed),
s AS (SELECT samples.* FROM samples JOIN mixed USING (problem_id))
SELECT part, count(*) AS n_problems, round(avg(pass1), 6) AS random, round(avg(majority), 6) AS self_consistency, round(avg(verifier), 6) AS verification,
  round(avg(passk), 6) AS oracle, round((SELECT auc FROM (""" + pair_auc("s", score="score", label="solved") + """)), 6) AS verifier_auc FROM parts GROUP BY 1""")
def selection_report(spark, sf):
    return rounded(SL.report(S.samples(spark, sf)))


@query("verifier_separation", "WITH " + S.SQL["samples"] + """
SELECT problem_id, round(avg(score) FILTER (solved = 1), 6) AS correct_score, round(avg(score) FILTER (solved = 0), 6) AS incorrect_score
FROM samples GROUP BY 1 HAVING min(solved) = 0 AND max(solved) = 1""")
def verifier_separation(spark, sf):
    return rounded(SL.separation(S.samples(spark, sf)))


@query("verifier_auc", _PROBLEMS + """,
s AS (SELECT 'all' AS part, score, solved FROM samples JOIN mixed USING (problem_id)
  UNION ALL SELECT 'held_out', score, solved FROM samples JOIN mixed USING (problem_id) WHERE greedy = 0)
SELECT part, round(auc, 6) AS auc, n_pos, n_neg FROM (""" + pair_auc("s", "part", score="score", label="solved") + ")")
def verifier_auc(spark, sf):
    return rounded(SL.separation_auc(S.samples(spark, sf)))


@query("frontier_calibration", "WITH " + S.SQL["samples"] + """,
p AS (SELECT difficulty, problem_id, sum(solved) AS s, count(*) AS n FROM samples GROUP BY ALL)
SELECT difficulty, round(sum(s) / sum(n), 6) AS solve_rate, count(*) AS n_problems, count(*) FILTER (s > 0 AND s < n) AS n_mixed FROM p GROUP BY 1""")
def frontier_calibration(spark, sf):
    return rounded(SL.calibration(S.samples(spark, sf)))


# ---------------------------------------------------------------- shift


_FEATURES = ["f__n_observation_chars", "f__n_edit", "f__avg_observation_chars"]


@query("quantile_alignment", "WITH " + BASE_SQL + """,
src AS (SELECT * FROM base_flags WHERE model_name = 'm0'), tgt AS (SELECT * FROM base_flags WHERE model_name <> 'm0'),
""" + ",\n".join(f"""q{i} AS (SELECT list(CAST({c[3:]} AS DOUBLE) ORDER BY {c[3:]}) AS l, count(*) AS n FROM src),
p{i} AS (SELECT prefix_id, (rank() OVER (ORDER BY {c[3:]}) + (count(*) OVER (PARTITION BY {c[3:]}) - 1) / 2.0 - 0.5) / count(*) OVER () AS pct FROM tgt),
a{i} AS (SELECT prefix_id, l[CAST(floor(pct * (n - 1)) AS BIGINT) + 1] + (l[CAST(ceil(pct * (n - 1)) AS BIGINT) + 1] - l[CAST(floor(pct * (n - 1)) AS BIGINT) + 1]) * (pct * (n - 1) - floor(pct * (n - 1))) AS v FROM p{i}, q{i})"""
                                 for i, c in enumerate(_FEATURES)) + """
SELECT prefix_id, """ + ", ".join(f"round(a{i}.v, 6) AS {c}" for i, c in enumerate(_FEATURES)) + """
FROM a0 JOIN a1 USING (prefix_id) JOIN a2 USING (prefix_id)""")
def quantile_alignment(spark, sf):
    p = reuse(prefixes(spark, sf).select("prefix_id", "model_name", *_FEATURES))
    moved = SH.align(p.where("model_name = 'm0'"), p.where("model_name <> 'm0'"), _FEATURES)
    return rounded(moved.drop("model_name"))


@query("rank_ensemble", RISK + """,
r AS (SELECT prefix_id, rank() OVER (ORDER BY risk) + (count(*) OVER (PARTITION BY risk) - 1) / 2.0
  + rank() OVER (ORDER BY prefix_step) + (count(*) OVER (PARTITION BY prefix_step) - 1) / 2.0 AS e FROM risk)
SELECT prefix_id, round(e, 6) AS ensemble FROM r""")
def rank_ensemble(spark, sf):
    r = reuse(S.risk(spark, sf).select("prefix_id", "risk", "prefix_step"))
    return rounded(SH.rank_ensemble(r, ["risk", "prefix_step"]).select("prefix_id", "ensemble"))


@query("last_prefix_auc", RISK + """,
l AS (SELECT trajectory_id, max(y_fail) AS y_fail, arg_max(risk, prefix_step) AS risk FROM risk GROUP BY 1)
SELECT round(auc, 6) AS auc, n_pos, n_neg FROM (""" + pair_auc("l") + ")")
def last_prefix_auc(spark, sf):
    return rounded(SH.last_prefix_auc(S.risk(spark, sf)))


@query("gated_auc", RISK + """,
g AS (SELECT CAST(f AS BIGINT) AS step_floor, risk, y_fail FROM risk JOIN (VALUES (25), (35)) v(f) ON prefix_step >= f)
SELECT step_floor, round(auc, 6) AS auc, round((n_pos + n_neg) / (SELECT count(*) FROM risk), 6) AS coverage FROM (""" + pair_auc("g", "step_floor") + """)
WHERE n_pos + n_neg > 50""")
def gated_auc(spark, sf):
    return rounded(SH.gated_auc(reuse(S.risk(spark, sf)), [25, 35]))


@query("captured_over_firing", "WITH " + S.SQL["risk_steps"] + """
SELECT y_fail, count(*) AS n_prefixes, round(avg(risk), 6) AS mean_risk, round(avg(CAST(risk >= 0.7 AS BIGINT)), 6) AS above_ungated,
  round(avg(CAST(prefix_step >= 10 AND risk >= 0.8 AS BIGINT)), 6) AS above_gated FROM risk_steps GROUP BY 1""")
def captured_over_firing(spark, sf):
    """Captured risk arrays, at most 1000 steps to an array, flattened and counted."""
    r = S.risk(spark, sf, every_step=True)
    captured = r.groupBy("trajectory_id", "y_fail", F.floor(F.col("prefix_step") / 1000).alias("part")).agg(
        F.collect_list(F.struct(F.col("prefix_step").alias("step"), "risk")).alias("risks"))
    return rounded(SH.over_firing(SH.flatten_capture(captured), 0.7, 0.8, 10))


@query("experiments_by_gain", RISK + """
SELECT 'model ' || model_name AS experiment, round(auc - (SELECT auc FROM (""" + pair_auc("risk") + """)), 6) AS delta FROM (""" + pair_auc("risk", "model_name") + ")")
def experiments_by_gain(spark, sf):
    from trailcast.operators.metrics import roc_auc
    from trailcast.operators.ordering import attach

    r = reuse(S.risk(spark, sf))
    base = roc_auc(r).select(F.col("auc").alias("base"))
    per = attach(roc_auc(r, by=["model_name"]), base).select(
        F.concat(F.lit("model "), "model_name").alias("experiment"), (F.col("auc") - F.col("base")).alias("delta"))
    return SH.rank_by_gain(rounded(per))
