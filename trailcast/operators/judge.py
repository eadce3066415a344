"""Tables around an external judge: requests out, replies in, comparison with a score.

Calling the judge is outside this package.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trailcast.functions import text as T
from trailcast.operators.metrics import average_precision, roc_auc
from trailcast.operators.ordering import attach
from trailcast.operators.resampling import paired_auc_delta
from trailcast.operators.scan import RunScan, recent_list

# The words of the request and of the reply.
SYSTEM_PROMPT = (
    "You are a monitor judging a coding-agent trajectory prefix. "
    "You see only the prefix so far; you do NOT know the final answer or outcome. "
    "Estimate whether the agent is drifting toward failure.")
USER_PROMPT = """Below is the prefix of a coding agent's run so far (%d steps shown).

%s

Return JSON matching the schema (BE TERSE — at most 2 items per list, <= 10 words each):
- risk_score: 0.0 = very healthy / on-track, 1.0 = very likely to fail
- likely_failure_modes: <= 2 short failure modes you observe
- should_intervene: true only if an intervention would likely help more than hurt
- intervention_type: one of none, loop_guard, evidence_gate, rollback_suggest
- evidence: <= 2 concrete observations from the prefix
Do not assume failure just because the run is long. Judge only from the evidence."""
INTERVENTION_TYPES = ["none", "loop_guard", "evidence_gate", "rollback_suggest"]
REPLY = ("risk_score double, likely_failure_modes array<string>, should_intervene boolean, "
         "intervention_type string, evidence array<string>, _bad string")


def transcripts(steps: DataFrame, scan: RunScan, recent: int = 12, action_chars: int = 240,
                observation_chars: int = 300) -> DataFrame:
    """(trajectory_id, prefix_step, transcript) of the last steps before and at every step.

    ``steps`` has ``action_type`` and the texts.
    """
    action = T.head(F.replace(T.strip(F.col("action_text")), F.lit("\n"), F.lit(" ")), action_chars)
    obs = F.replace(T.head(T.strip(F.col("observation_text")), observation_chars), F.lit("\n"), F.lit(" "))
    number = (F.col("step_index") + 1).cast("string")
    line = F.concat(
        F.lit("[step "), number, F.lit("] ("), F.col("action_type"), F.lit(") $ "), action,
        F.when(obs != "", F.concat(F.lit("\n    -> "), obs)).otherwise(F.lit("")))
    s = scan.apply(steps.select("trajectory_id", "step_index", line.alias("line")),
                   lines=recent_list(F.col("line"), recent))
    return s.select("trajectory_id", (F.col("step_index") + 1).alias("prefix_step"),
                    F.array_join("lines", "\n").alias("transcript"))


def requests(sample: DataFrame, rendered: DataFrame) -> DataFrame:
    """One request per sampled prefix."""
    return sample.join(rendered, ["trajectory_id", "prefix_step"]).select(
        "prefix_id", "trajectory_id", "prefix_step", F.lit(SYSTEM_PROMPT).alias("system"),
        F.format_string(USER_PROMPT, F.col("prefix_step"), F.col("transcript")).alias("user"))


def parse_reply(reply: Column) -> Column:
    """Struct of the JSON object inside a reply; NULL when there is no valid one."""
    bare = F.regexp_replace(F.coalesce(reply, F.lit("")), r"(?i)```(?:json)?", "")
    body = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    parsed = F.from_json(body, REPLY, {"columnNameOfCorruptRecord": "_bad"})
    ok = parsed["_bad"].isNull() & parsed["risk_score"].between(0.0, 1.0)
    return F.when(ok, parsed)


def read_replies(replies: DataFrame, fallback: float = 0.5) -> DataFrame:
    """Risk, validity and advice of each reply; invalid replies get the fallback risk."""
    r = replies.withColumn("_j", parse_reply(F.col("reply")))
    kind = F.coalesce("_j.intervention_type", F.lit("none"))
    return r.withColumns({
        "valid_json": F.col("_j").isNotNull().cast("bigint"),
        "judge_risk": F.coalesce("_j.risk_score", F.lit(fallback)),
        "should_intervene": F.coalesce("_j.should_intervene", F.lit(False)).cast("bigint"),
        "intervention_type": F.when(kind.isin(INTERVENTION_TYPES), kind).otherwise("none")}).drop("_j")


def report(judged: DataFrame, n_boot: int = 2000, score: str = "risk") -> DataFrame:
    """Judge against the classifier on the same prefixes."""
    overall = judged.agg(
        F.count(F.lit(1)).alias("n"), F.sum("y_fail").alias("n_pos"),
        (1 - F.avg(F.col("valid_json").cast("double"))).alias("invalid_json_rate"),
        F.avg("latency_s").alias("avg_latency_s"),
        F.avg(F.col("should_intervene").cast("double")).alias("should_intervene_rate"))
    out = attach(overall, roc_auc(judged, "judge_risk").select(F.col("auc").alias("judge_auc")))
    out = attach(out, average_precision(judged, "judge_risk").select(F.col("average_precision").alias("judge_auprc")))
    out = attach(out, average_precision(judged, score).select(F.col("average_precision").alias("classifier_auprc")))
    out = attach(out, roc_auc(judged.where("valid_json = 1"), "judge_risk").select(F.col("auc").alias("judge_auc_valid")))
    paired = paired_auc_delta(judged, score, "judge_risk", n_boot=n_boot).select(
        F.col("auc_base").alias("classifier_auc"), F.col("delta").alias("delta_judge"), "delta_lo", "delta_hi",
        F.col("frac_new_better").alias("frac_judge_better"))
    return attach(out, paired)


def costs(judged: DataFrame, price_in: float, price_out: float, project_to: int) -> DataFrame:
    """Token totals, their price per million tokens and the price of ``project_to`` calls."""
    t = judged.agg(F.count(F.lit(1)).alias("n"), F.sum("prompt_tokens").alias("tokens_in"),
                   F.sum("completion_tokens").alias("tokens_out"))
    cost = F.col("tokens_in") / 1e6 * price_in + F.col("tokens_out") / 1e6 * price_out
    return t.select("n", "tokens_in", "tokens_out", cost.alias("cost"),
                    ((F.col("tokens_in") + F.col("tokens_out")) / F.col("n")).alias("tokens_per_call"),
                    (cost / F.col("n") * project_to).alias("projected_cost"))
