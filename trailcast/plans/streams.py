"""Streaming queries, run to the end of the staged step table."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailcast.plans.decisions import replay_sql
from trailcast.operators import prefixes as PX
from trailcast.operators.features import BASE_FEATURES
from trailcast.plans.features import DYNAMICS_SQL, base_output_sql, rounded
from trailcast.plans.registry import query
from trailcast.plans.training import fitted_monitor
from trailcast.sources import standin as S
from trailcast.streaming import alert_policy as AP
from trailcast.streaming import scoring as SC
from trailcast.streaming import step_dynamics as SD
from trailcast.streaming import step_features as SF

STEP_COLUMNS = ["trajectory_id", "instance_id", "model_name", "step_index", "thought_text", "action_text", "observation_text"]


def step_stream(spark, sf, files=None, files_per_batch=1000):
    folder, schema = AP.staged(S.steps(spark, sf).select(*STEP_COLUMNS), files)
    return folder, AP.open_steps(spark, f"{folder}/input", schema, files_per_batch)


# Compression depends on the deflate library; a test compares it with the batch operator.
_EXACT = [n for n in SD.DOUBLES if "compress" not in n] + SD.LONGS


@query("stream_step_features", "WITH " + DYNAMICS_SQL.replace(f"WHERE {S.ON_SCHEDULE_SQL}", "") + f"""
SELECT trajectory_id, {base_output_sql(BASE_FEATURES)},
  {", ".join(f"round(CAST({n} AS DOUBLE), 6) AS f__{n}" if n in SD.DOUBLES else f"CAST({n} AS BIGINT) AS f__{n}" for n in _EXACT)}
FROM dynamics""")
def stream_step_features(spark, sf):
    """Base and dynamics features of every step, from keyed state."""
    folder, steps = step_stream(spark, sf)
    out = AP.run_to_end(SF.feature_stream(steps, dynamics=True, similarity="edit"), folder)
    return rounded(out.select("trajectory_id", *[F.col(n).alias(f"f__{n}") for n in [*BASE_FEATURES, *_EXACT]]))


_HOLE = "(step_index * 7 + CAST(substr(trajectory_id, 2) AS BIGINT)) % 11 = 5"
_COUNTED = ["n_read", "n_edit", "n_test", "n_actions_seen", "n_observation_chars"]


@query("stream_missing_steps", "WITH " + S.SQL["steps"] + f""",
kept AS (SELECT *, epoch_ms(ts) AS at_ms FROM steps WHERE NOT {_HOLE}),
gaps AS (
  SELECT *, step_no - coalesce(lag(step_no) OVER run, 0) - 1 AS gap FROM kept WINDOW run AS (PARTITION BY trajectory_id ORDER BY step_no)),
marked AS (
  SELECT *, max(CASE WHEN gap > 0 THEN at_ms + 172800000 END) OVER run AS until, sum(gap) OVER run AS n_missing,
    count(*) FILTER (event_type = 'view') OVER run AS n_read, count(*) FILTER (event_type = 'purchase') OVER run AS n_edit,
    count(*) FILTER (event_type = 'error') OVER run AS n_test, count(*) OVER run AS n_actions_seen,
    sum(length(observation_text)) OVER run AS n_observation_chars
  FROM gaps WINDOW run AS (PARTITION BY trajectory_id ORDER BY step_no ROWS UNBOUNDED PRECEDING))
SELECT trajectory_id, step_no AS prefix_step, gap, CAST(n_missing AS BIGINT) AS n_missing,
  {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in _COUNTED)}
FROM marked WHERE until IS NULL OR until <= (SELECT max(at_ms) - 43200000 FROM kept)""")
def stream_missing_steps(spark, sf):
    """A shuffled stream with holes and repeats: a run goes on two days after the first step beyond a hole."""
    steps = S.steps(spark, sf).select(*STEP_COLUMNS, "ts").where(f"NOT {_HOLE}")
    shuffled = steps.unionByName(steps.where("step_index % 3 = 1")).withColumn("_h", F.rand(5)).repartition(4, "_h").sortWithinPartitions(
        "_h").drop("_h")
    folder, schema = AP.staged(shuffled)
    stream = SF.feature_stream(AP.open_steps(spark, f"{folder}/input", schema), wait_seconds=172800, delay="12 hours")
    return AP.run_to_end(stream, folder).select("trajectory_id", "prefix_step", "gap", "n_missing", *_COUNTED)


@query("stream_monitor_verdicts")
def stream_monitor_verdicts(spark, sf):
    """The fitted monitor inside the stream: features, model and calibrator, intervention, policy."""
    rows, model, calibrator = fitted_monitor(spark, sf)
    runs = rows.where("fold = 'test'").select("trajectory_id").distinct()
    steps = S.steps(spark, sf).select(*STEP_COLUMNS).join(runs, "trajectory_id", "left_semi")
    folder, schema = AP.staged(steps)
    SC.publish(spark, f"{folder}/models", 1, model, calibrator)
    features = SF.feature_stream(AP.open_steps(spark, f"{folder}/input", schema))
    # A stream does not know which step is a run's last, so only the other scheduled ones are judged.
    judged = PX.on_schedule(F.col("prefix_step"), F.col("prefix_step") + 1)
    return SC.verdicts_to_end(spark, features, f"{folder}/models", folder, AP.AlertPolicy(0.6, conf_floor=0.05), judged)


@query("stream_alert_verdicts", "WITH " + S.SQL["risk_steps"] + "," + replay_sql("u", 5, 0.1, 0.6, cooldown=5) + """
SELECT trajectory_id, prefix_step, CAST(prefix_step = coalesce(a1, -1) OR prefix_step = coalesce(a2, -1) AS BIGINT) AS alarm,
  CAST(prefix_step < 5 OR abs(risk - 0.5) < 0.1 AS BIGINT) AS abstain FROM risk_steps r JOIN u USING (trajectory_id)""")
def stream_alert_verdicts(spark, sf):
    folder, schema = AP.staged(S.risk(spark, sf, every_step=True).select("trajectory_id", "prefix_step", "risk"))
    scored = AP.open_steps(spark, f"{folder}/input", schema)
    out = AP.run_to_end(AP.verdict_stream(scored, AP.AlertPolicy(0.6, conf_floor=0.1)), folder)
    return out.select("trajectory_id", "prefix_step", "alarm", "abstain")


@query("stream_shadow_capture", "WITH " + S.SQL["risk_steps"] + """
SELECT trajectory_id, count(*) AS n_steps, round(sum(risk), 6) AS total_risk, CAST(0 AS BIGINT) AS alarms FROM risk_steps GROUP BY 1""")
def stream_shadow_capture(spark, sf):
    """Shadow mode from step text to captured risk: features, score and policy in one stream, no alarm raised."""
    folder, steps = step_stream(spark, sf)
    features = SF.feature_stream(steps)
    scored = features.withColumn("risk", F.round(1 / (1 + F.exp(-(F.col("n_test") - F.col("n_edit")) / F.lit(3.0))), 6))
    verdicts = AP.run_to_end(AP.verdict_stream(scored, AP.AlertPolicy(0.6, min_step=0, shadow=True)), folder)
    captured = AP.captured_runs(verdicts).select("trajectory_id", F.explode("risks").alias("r"))
    alarms = verdicts.groupBy("trajectory_id").agg(F.sum("alarm").alias("alarms"))
    return captured.groupBy("trajectory_id").agg(
        F.count(F.lit(1)).alias("n_steps"), F.round(F.sum("r.risk"), 6).alias("total_risk")).join(alarms, "trajectory_id")
