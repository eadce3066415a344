"""Queries that fit models. They have no SQL twin; tests check their invariants.

All fits use the full settings. The feature table is checkpointed first: fitting plans many
small jobs over it, and each would otherwise carry the whole feature plan.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trailcast.operators import abstention as AB
from trailcast.operators import alerts as AL
from trailcast.operators import features as FT
from trailcast.operators import interventions as IV
from trailcast.operators import metrics as M
from trailcast.operators import models as MD
from trailcast.operators import report as RP
from trailcast.operators import resampling as RS
from trailcast.operators import sampling as SA
from trailcast.operators import shift as SH
from trailcast.operators import splits as SP
from trailcast.operators.aggregates import position_strata_auc, run_success_rate
from trailcast.operators.calibration import fit_calibrator
from trailcast.operators.labels import position_weights, shaped_labels
from trailcast.operators.ordering import attach
from trailcast.plans.decisions import prefixes, with_recent
from trailcast.plans.evaluation import RISK, folds_sql, part_shared_instances
from trailcast.plans.probes import contrast
from trailcast.plans.registry import query
from trailcast.session import cut_lineage
from trailcast.sources import standin as S


def folds(spark, sf, table=None):
    """Train, validation and test prefixes with features."""
    rows = cut_lineage(SP.split(cut_lineage(table if table is not None else prefixes(spark, sf))))
    return tuple(rows.where(F.col("fold") == f) for f in ("train", "val", "test"))


@query("majority_baseline", RISK + "," + folds_sql() + """
SELECT prefix_id, round((SELECT avg(y_fail) FROM risk JOIN folds USING (instance_id) WHERE fold = 'train'), 6) AS risk
FROM risk JOIN folds USING (instance_id) WHERE fold = 'test'""")
def majority_baseline(spark, sf):
    r = cut_lineage(SP.split(S.risk(spark, sf).drop("risk")))
    model = MD.fit("baseline_majority", r.where("fold = 'train'"))
    return model.score(r.where("fold = 'test'")).select("prefix_id", F.round("risk", 6).alias("risk"))


@query("model_comparison_table")
def model_comparison_table(spark, sf):
    steps = S.steps(spark, sf)
    train, val, test = folds(spark, sf, FT.prefix_table(steps, S.runs(steps), text=True))
    models = MD.fit_all(MD.ROSTER, train)
    return RP.comparison_table(*RP.score_folds(models, val, test), list(models))


@query("feature_ablation_table")
def feature_ablation_table(spark, sf):
    steps = S.steps(spark, sf)
    train, val, test = folds(spark, sf, FT.prefix_table(steps, S.runs(steps), text=True))
    families = [[f] for f in FT.FAMILIES] + [["all_structured"], ["all_structured_plus_text"]]
    return RP.ablation_table(train, val, test, families)


@query("shuffled_label_auc")
def shuffled_label_auc(spark, sf):
    train, val, _ = folds(spark, sf)
    real = MD.fit("logistic_regression", train)
    control = MD.fit_shuffled(train)
    return attach(M.roc_auc(real.score(val)).select(F.col("auc").alias("real_auc")),
                  M.roc_auc(control.score(val)).select(F.col("auc").alias("shuffled_auc")))


@query("calibrated_reliability")
def calibrated_reliability(spark, sf):
    train, val, test = folds(spark, sf)
    model = MD.fit("logistic_regression", train)
    v, t = cut_lineage(model.score(val)), cut_lineage(model.score(test))
    out = M.reliability(t).withColumn("method", F.lit("raw"))
    for method in ("platt", "isotonic"):
        c = fit_calibrator(v, method)
        out = out.unionByName(M.reliability(c.apply(t), "calibrated").withColumn("method", F.lit(method)))
    return out


@query("feature_importance")
def feature_importance(spark, sf):
    train, _, _ = folds(spark, sf)
    return MD.importance(MD.fit("logistic_regression", train))


@query("blended_scores")
def blended_scores(spark, sf):
    train, val, test = folds(spark, sf)

    shorts = {"gradient_boosting": "p_boost", "random_forest": "p_forest", "logistic_regression": "p_linear"}
    models = MD.fit_all(list(shorts), train)
    both = val.unionByName(test)
    for name, short in shorts.items():
        both = models[name].score(both, short)
    both = cut_lineage(both.select(*RP.SLIM, "fold", *shorts.values()))
    scored_val, scored_test = (both.where(F.col("fold") == f).drop("fold") for f in ("val", "test"))
    winner, out = MD.blend(scored_val, scored_test, list(shorts.values()))
    return out.withColumn("combiner", F.lit(winner))


@query("feature_set_comparison")
def feature_set_comparison(spark, sf):
    """Base against base plus dynamics: chosen on validation, one paired test."""
    steps = S.steps(spark, sf)
    table = FT.prefix_table(steps, S.runs(steps), features="dynamics")
    train, val, test = folds(spark, sf, table)
    everything = [c for c in train.columns if c.startswith("f__")]
    base = [c for c in everything if not c.startswith("f__adv_")]
    return MD.compare_candidates(train, val, test, {"base": base, "dynamics": everything}, "base")


@query("label_scheme_comparison")
def label_scheme_comparison(spark, sf):
    """Training with gated labels, noise weights and position weights, evaluated on terminal labels."""
    train, _, test = folds(spark, sf)
    shaped = cut_lineage(position_weights(shaped_labels(train)))
    columns = [c for c in train.columns if c.startswith("f__")]
    fits = {"terminal": {}, "gated": {"label": "y_gated"}, "noise_weighted": {"weight": "w_noisy"},
            "late_weighted": {"weight": "w_late"}}
    models = {n: MD.fit("gradient_boosting", shaped, columns, **kw) for n, kw in fits.items()}
    scored = RP.score_models(models, test)
    out = None
    for n in fits:
        part = position_strata_auc(scored.where(F.col("model") == n)).withColumn("scheme", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out


@query("out_of_fold_auc")
def out_of_fold_auc(spark, sf):
    return M.roc_auc(MD.out_of_fold(cut_lineage(prefixes(spark, sf)), "logistic_regression"))


@query("cross_model_transfer")
def cross_model_transfer(spark, sf):
    """A model trained on one agent, applied to the others, with and without recalibration."""
    rows = cut_lineage(SP.transfer_roles(part_shared_instances(cut_lineage(prefixes(spark, sf))), "m0"))
    model = MD.fit("gradient_boosting", rows.where("role = 'train'"))
    held, target = cut_lineage(model.score(rows.where("role = 'holdout'"))), cut_lineage(
        SA.half(model.score(rows.where("role = 'target'")), "prefix_id"))
    naive = fit_calibrator(held).apply(target)
    both = fit_calibrator(target.where("first_half = 1")).apply(naive, out="recalibrated").withColumn(
        "held_out", F.col("first_half") == 0)
    return SH.transfer_report(held, cut_lineage(both), 0.7)


@query("second_source_transfer")
def second_source_transfer(spark, sf):
    """Frozen model on another source: naive, on aligned features, as ensemble, few-shot, at the last prefix."""
    p = cut_lineage(prefixes(spark, sf))
    source, target = p.where("model_name = 'm0'"), cut_lineage(p.where("model_name <> 'm0'"))
    columns = [f"f__{c}" for c in FT.FAMILIES["action_counts"] + FT.FAMILIES["loop_behavior"]]
    loops = [f"f__{c}" for c in FT.FAMILIES["loop_behavior"]]
    model = MD.fit("gradient_boosting", source, columns)
    loop_model = MD.fit("gradient_boosting", source, loops)
    aligned = SH.align(source, target.select("prefix_id", *columns), columns)
    naive = loop_model.score(model.score(target, "p_naive"), "p_loop").select(
        "prefix_id", "trajectory_id", "instance_id", "prefix_step", "y_fail", "p_naive", "p_loop")
    scores = cut_lineage(naive.join(model.score(aligned, "p_aligned").select("prefix_id", "p_aligned"), "prefix_id"))
    ens = SH.rank_ensemble(scores, ["p_aligned", "p_loop"])
    own = MD.out_of_fold(target.select("prefix_id", "instance_id", "y_fail", *columns), "gradient_boosting", out="p_own")
    all_scores = ens.join(own.select("prefix_id", "p_own"), "prefix_id")
    few = cut_lineage(SH.rank_ensemble(all_scores.withColumnRenamed("ensemble", "p_ens"), ["p_ens", "p_own"]))
    out = SH.last_prefix_auc(few, "p_ens").withColumn("variant", F.lit("post_hoc"))
    for column, name in (("p_naive", "naive"), ("p_aligned", "aligned"), ("p_ens", "ensemble"), ("p_own", "in_domain"), ("ensemble", "few_shot")):
        out = out.unionByName(M.roc_auc(few, column).withColumn("variant", F.lit(name)))
    return out.select("variant", "auc", "n_pos", "n_neg")


@query("matched_budget_monitorability")
def matched_budget_monitorability(spark, sf):
    """AUC per agent from equally many instances, averaged over random instance subsets.

    All fits (agents, subsets and folds) are grown side by side.
    """
    p = cut_lineage(prefixes(spark, sf))
    picks = None
    for agent in [r.model_name for r in p.select("model_name").distinct().orderBy("model_name").collect()]:  # agents are few
        own = SA.subsets(p.where(F.col("model_name") == agent), "instance_id", 60, 20).withColumn("model_name", F.lit(agent))
        picks = own if picks is None else picks.unionByName(own)
    rows = cut_lineage(p.join(picks, ["model_name", "instance_id"]))
    sets = ["model_name", "rep"]
    both = rows.groupBy(*sets).agg(F.count_distinct("y_fail").alias("classes")).where("classes = 2")  # no AUC of one class
    rows = cut_lineage(rows.join(both.select(*sets), sets))
    scored = MD.out_of_fold(rows, "gradient_boosting", k=5, by=sets, rounds=100, rate=0.1, l2=0.0)
    aucs = M.roc_auc(cut_lineage(scored.select(*sets, "y_fail", "risk")), by=sets)
    stats = aucs.groupBy("model_name").agg(F.avg("auc").alias("auc"), F.stddev_pop("auc").alias("auc_sd"))
    return stats.join(run_success_rate(p, ["model_name"]), "model_name")


@query("regime_comparison")
def regime_comparison(spark, sf):
    """Model for all prefixes against one retrained on late prefixes, both on late prefixes."""
    train, val, test = folds(spark, sf)
    late = F.col("prefix_step") >= 10
    full, regime = (MD.fit("gradient_boosting", rows) for rows in (train, train.where(late)))

    def calibrated(model, rows_val, rows, out):
        return fit_calibrator(cut_lineage(model.score(rows_val))).apply(model.score(rows, "_raw").withColumnRenamed("_raw", "risk"), out=out).drop("risk")

    both = calibrated(regime, val.where(late), calibrated(full, val, test.where(late), "p_full"), "p_regime")
    rows = cut_lineage(both.select(*RP.SLIM, "p_full", "p_regime"))
    cut = AL.false_alarm_threshold(cut_lineage(fit_calibrator(cut_lineage(full.score(val))).apply(full.score(val)).drop("risk").withColumnRenamed(
        "calibrated", "risk").where(late)), 0.10)
    alerts = AL.first_alert_metrics(rows.withColumnRenamed("p_full", "risk"), cut).drop("threshold")
    out = attach(RS.paired_auc_delta(rows, "p_full", "p_regime"), alerts)
    everyone = test.groupBy("trajectory_id").agg(F.max("y_fail").alias("y")).agg(
        F.sum("y").alias("all_failed"), F.sum(1 - F.col("y")).alias("all_success"))
    return attach(out, everyone).withColumns({
        "failed_coverage_all_runs": F.col("failed_alerted") / F.col("all_failed"),
        "false_alarm_rate_all_runs": F.col("success_false_alarmed") / F.col("all_success")})


def fitted_monitor(spark, sf):
    """Prefixes with folds, a model of the training part and its calibrator from the validation part."""
    rows = cut_lineage(SP.split(cut_lineage(with_recent(spark, sf).drop("risk"))))
    model = MD.fit("gradient_boosting", rows.where("fold = 'train'"))
    return rows, model, fit_calibrator(cut_lineage(model.score(rows.where("fold = 'val'"))))


@query("monitor_verdicts")
def monitor_verdicts(spark, sf):
    """Score, calibrate, abstain, decide: one verdict per test prefix, alarms under cooldown and budget."""
    rows, model, calibrator = fitted_monitor(spark, sf)
    scored = cut_lineage(calibrator.apply(model.score(rows.where("fold = 'test'"), "risk")))
    return IV.verdicts(scored, threshold=0.6, min_step=5, conf_floor=0.05)


@query("vector_logistic_probe")
def vector_logistic_probe(spark, sf):
    return MD.vector_probe(contrast(spark, sf), k=4)


@query("scored_operating_point")
def scored_operating_point(spark, sf):
    train, val, test = folds(spark, sf)
    model = MD.fit("gradient_boosting", train)
    return AB.operating_point(cut_lineage(model.score(val)), cut_lineage(model.score(test)))
