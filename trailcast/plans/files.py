"""Queries through files: logs and tables are written, read back and resumed in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trailcast.operators import normalize as N
from trailcast.plans.registry import query
from trailcast.session import shared_folder
from trailcast.sources import files as FS
from trailcast.sources import standin as S

RISK = "WITH " + S.SQL["risk"]


def new_path(spark, suffix):
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}.{suffix}"


@query("runs_from_json_lines", """
SELECT concat(conv_id, '-', turn) AS instance_id, role AS model_name, CAST(turn % 2 = 0 AS VARCHAR) AS target, text AS content FROM conversations""")
def runs_from_json_lines(spark, sf):
    """Raw logs with the whole message text, from JSON lines with a nested trajectory."""
    m = S.table(spark, sf, "conversations")
    path = new_path(spark, "jsonl")
    FS.write_table(m.select(
        F.concat_ws("-", "conv_id", "turn").alias("instance_id"), F.col("role").alias("model_name"),
        (F.col("turn") % 2 == 0).alias("target"),
        F.array(F.struct("role", F.col("text").alias("content"))).alias("trajectory")), path)
    return FS.read_runs(spark, "full", {"full": path}).select(
        "instance_id", "model_name", "target", F.get_json_object("trajectory", "$[0].content").alias("content"))


@query("tool_log_raw_messages", """
SELECT concat('i', conv_id) AS instance_id, CAST(turn % 3 > 0 AS BIGINT) AS target, pos,
  CASE pos WHEN 0 THEN role ELSE 'assistant' END AS role, CASE pos WHEN 0 THEN text ELSE concat('run ', turn) END AS content,
  CASE pos WHEN 1 THEN 'execute_bash' END AS call, CASE pos WHEN 1 THEN concat('ls ', turn) END AS command
FROM conversations, (VALUES (CAST(0 AS BIGINT)), (CAST(1 AS BIGINT))) AS p(pos)""")
def tool_log_raw_messages(spark, sf):
    """The tool-call dialect from its raw form: JSON texts inside JSON lines."""
    m = S.table(spark, sf, "conversations")
    turn = F.col("turn").cast("string")
    arguments = F.to_json(F.struct(F.concat(F.lit("ls "), turn).alias("command")))
    calls = F.array(F.struct(F.concat(F.lit("c"), turn).alias("id"), F.struct(
        F.lit("execute_bash").alias("name"), arguments.alias("arguments")).alias("function")))
    messages = F.array(
        F.struct("role", F.col("text").alias("content"), F.when(F.lit(False), calls).alias("tool_calls")),
        F.struct(F.lit("assistant").alias("role"), F.concat(F.lit("run "), turn).alias("content"), calls.alias("tool_calls")))
    path = new_path(spark, "jsonl")
    FS.write_table(m.select(
        F.to_json(F.struct(F.concat(F.lit("i"), F.col("conv_id").cast("string")).alias("instance_id"))).alias("ds"),
        F.to_json(messages).alias("messages"), (F.col("turn") % 3 / 2.0).alias("reward")), path)
    call = F.get("tool_calls", F.lit(0))
    return N.read_tool_log(FS.read_json_lines(spark, path, FS.TOOL_SCHEMA)).select(
        "instance_id", F.col("target").cast("bigint").alias("target"), F.col("pos").cast("bigint").alias("pos"), "role", "content",
        call["name"].alias("call"), F.get_json_object(call["arguments"], "$.command").alias("command"))


@query("csv_round_trip", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_round_trip(spark, sf):
    """Whole texts with quotes, line breaks and outer blanks through CSV."""
    path = new_path(spark, "csv")
    FS.write_table(S.table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars"), path)
    return FS.read_table(spark, path, "doc_id bigint, text string, lang string, source string, n_chars bigint", multiline=True)


@query("resumed_scores", RISK + " SELECT prefix_id, risk FROM risk")
def resumed_scores(spark, sf):
    """A scoring run that stopped after the even steps goes on with the rest; nothing is scored twice."""
    path = new_path(spark, "parquet")
    todo = S.risk(spark, sf).select("prefix_id", "prefix_step", "risk")
    for part in (todo.where("prefix_step % 2 = 0"), todo):
        results = FS.score_remaining(part, path, ["prefix_id"], lambda rows: rows.select("prefix_id", "risk"))
    return results


@query("paired_score_tables", RISK + " SELECT prefix_id, risk, 1 - risk AS other FROM risk")
def paired_score_tables(spark, sf):
    """Two score tables of the same prefixes, which must pair up one to one."""
    r = S.risk(spark, sf)
    return FS.one_to_one(r.select("prefix_id", "risk"), r.select("prefix_id", (1 - F.col("risk")).alias("other")), ["prefix_id"])
