"""Queries over raw logs and step text: normalization, dialects and text expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailcast.functions import patterns as P
from trailcast.functions import text as T
from trailcast.operators import normalize as N
from trailcast.operators.scan import by_run_length, previous
from trailcast.operators.step_signals import classify
from trailcast.plans.features import CLASSIFIED, quoted, rounded
from trailcast.plans.registry import query
from trailcast.sources import standin as S

WS = "concat(" + ", ".join(f"chr({ord(c)})" for c in P.WHITESPACE) + ")"


def strip_sql(expression: str) -> str:
    return f"trim({expression}, {WS})"


# ---------------------------------------------------------------- chat logs


def chat_messages(spark, sf):
    """Conversations in which assistant texts take three forms: plain, fenced and labelled."""
    m = S.messages(spark, sf)
    form, text = F.col("pos") % 3, F.col("text")
    shaped = (F.when(F.col("role") != "assistant", text)
              .when(form == 0, text)
              .when(form == 1, F.concat(F.lit("look closer\n```bash\n"), text, F.lit("\n```\ndone")))
              .otherwise(F.concat(F.lit("THOUGHT: step "), F.col("pos").cast("string"), F.lit(" ACTION: "), text)))
    return m.select(F.col("run").cast("string").alias("trajectory_id"), "pos", "role", shaped.alias("text"))


_CHAT = "WITH " + S.SQL["messages"] + f""",
chat AS (
  SELECT CAST(run AS VARCHAR) AS trajectory_id, pos, role, CASE WHEN role <> 'assistant' OR pos % 3 = 0 THEN text
    WHEN pos % 3 = 1 THEN concat('look closer', chr(10), '```bash', chr(10), text, chr(10), '```', chr(10), 'done')
    ELSE concat('THOUGHT: step ', pos, ' ACTION: ', text) END AS text, text AS inner_text FROM messages),
turns AS (SELECT *, sum(CAST(role = 'assistant' AS BIGINT)) OVER (PARTITION BY trajectory_id ORDER BY pos) - 1 AS step_index FROM chat)"""


@query("chat_message_pairing", _CHAT + f"""
SELECT trajectory_id, CAST(step_index AS BIGINT) AS step_index,
  left(any_value(text) FILTER (role = 'assistant'), 8000) AS raw_text,
  left(any_value(CASE WHEN pos % 3 = 0 THEN {strip_sql('inner_text')} WHEN pos % 3 = 1 THEN concat('look closer', chr(10), chr(10), 'done')
    ELSE concat('step ', pos) END) FILTER (role = 'assistant'), 8000) AS thought_text,
  left(any_value({strip_sql('inner_text')}) FILTER (role = 'assistant'), 8000) AS action_text,
  left(coalesce(string_agg(nullif(text, ''), chr(10) ORDER BY pos) FILTER (role <> 'assistant'), ''), 8000) AS observation_text
FROM turns WHERE step_index >= 0 GROUP BY ALL""")
def chat_message_pairing(spark, sf):
    return by_run_length(chat_messages(spark, sf), N.steps_of_chat, position="pos")


@query("live_log_steps", _CHAT + """,
live AS (SELECT *, pos % 5 = 4 AS injected FROM turns)
SELECT trajectory_id, CAST(step_index AS BIGINT) AS step_index,
  left(any_value(text) FILTER (role = 'assistant'), 8000) AS thought_text,
  left(any_value(CASE WHEN pos % 2 = 0 THEN text ELSE concat('ls ', pos, chr(10), 'pwd') END) FILTER (role = 'assistant'), 8000) AS action_text,
  left(coalesce(string_agg(nullif(text, ''), chr(10) ORDER BY pos) FILTER (role <> 'assistant' AND NOT injected), ''), 8000) AS observation_text
FROM live WHERE step_index >= 0 GROUP BY ALL""")
def live_log_steps(spark, sf):
    pos = F.col("pos")
    none = F.array().cast("array<string>")
    m = chat_messages(spark, sf).select(
        "trajectory_id", "pos", "role", F.col("text").alias("content"), (pos % 5 == 4).alias("injected"),
        F.when(pos % 2 == 0, none).otherwise(
            F.array(F.concat(F.lit("ls "), pos.cast("string")), F.lit("pwd"))).alias("commands"))
    return by_run_length(m, N.steps_of_live_log, position="pos")


# ---------------------------------------------------------------- raw payloads


def raw_runs(spark, sf):
    """One raw run per conversation message, in six payload shapes."""
    m = S.table(spark, sf, "conversations")
    h = F.md5("text")
    a, b = F.substring(h, 1, 8), F.substring(h, 9, 8)

    def fill(template: str):
        out = F.lit(template)
        return F.replace(F.replace(out, F.lit("<a>"), a), F.lit("<b>"), b)

    shape = (F.col("conv_id") + F.col("turn")) % 6
    body = F.when(shape == 0, fill(_SHAPES[0]))
    for i in range(1, 6):
        body = body.when(shape == i, fill(_SHAPES[i]))
    return m.select(
        F.concat(F.lit("org__repo-"), (F.col("conv_id") % 20).cast("string")).alias("instance_id"),
        F.when(F.col("turn") % 3 > 0, F.lit("m")).alias("model_name"),
        F.element_at(F.array(F.lit("Resolved "), F.lit("no"), F.lit("1"), F.lit("false")),
                     (F.col("turn") % 4 + 1).cast("int")).alias("target"),
        body.alias("trajectory"), "conv_id", "turn")


_SHAPES = [
    '[{"thought":"t <a>","action":"cat src/<a>.py","observation":"o <b>"},{"response":"r <a>","observation":"","returncode":1},"junk"]',
    '[{"role":"system","content":"sys"},{"role":"user","text":"task <a>"},{"role":"ai","text":"think <a>\\n```\\nls <b>\\n```"},'
    '{"role":"user","content":"out <b>"},{"role":"user","content":""},{"role":"tool","content":"more"},{"role":"assistant","content":"ACTION: submit"}]',
    '{"history":[{"action":"rg <a>"}]}',
    '{"observation":"obs <a>"}',
    'free text <a>',
    '',
]
_RAW = f"""WITH raw AS (
  SELECT concat('org__repo-', conv_id % 20) AS instance_id, CASE WHEN turn % 3 > 0 THEN 'm' END AS model_name, turn % 2 = 0 AS ok,
    (conv_id + turn) % 6 AS shape, substr(md5(text), 1, 8) AS a, substr(md5(text), 9, 8) AS b,
    replace(replace(CASE (conv_id + turn) % 6 {" ".join(f"WHEN {i} THEN {quoted(s)}" for i, s in enumerate(_SHAPES))} END, '<a>', a), '<b>', b) AS trajectory
  FROM conversations),
ids AS (
  SELECT CASE WHEN attempt = 1 THEN base ELSE concat(base, '-', attempt) END AS trajectory_id, instance_id, model_name, y_fail, shape, a, b
  FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY y_fail) AS attempt FROM (
    SELECT *, CAST(NOT ok AS BIGINT) AS y_fail,
      substr(sha1(concat(instance_id, chr(31), coalesce(model_name, '?'), chr(31), substr(sha1(trajectory), 1, 10))), 1, 12) AS base FROM raw))),
steps_raw AS (
  SELECT trajectory_id, CAST(0 AS BIGINT) AS step_index, concat('t ', a) AS thought_text, concat('cat src/', a, '.py') AS action_text, concat('o ', b) AS observation_text, CAST(NULL AS BIGINT) AS returncode FROM ids WHERE shape = 0
  UNION ALL SELECT trajectory_id, 1, '', concat('r ', a), '', 1 FROM ids WHERE shape = 0
  UNION ALL SELECT trajectory_id, 0, concat('think ', a), concat('ls ', b), concat('out ', b, chr(10), 'more'), NULL FROM ids WHERE shape = 1
  UNION ALL SELECT trajectory_id, 1, '', 'submit', '', NULL FROM ids WHERE shape = 1
  UNION ALL SELECT trajectory_id, 0, '', concat('rg ', a), '', NULL FROM ids WHERE shape = 2
  UNION ALL SELECT trajectory_id, 0, '', '', concat('obs ', a), NULL FROM ids WHERE shape = 3
  UNION ALL SELECT trajectory_id, 0, '', '', concat('free text ', a), NULL FROM ids WHERE shape = 4)"""


@query("raw_payload_steps", _RAW + " SELECT * FROM steps_raw")
def raw_payload_steps(spark, sf):
    return N.normalize(raw_runs(spark, sf))[1].select(
        "trajectory_id", "step_index", "thought_text", "action_text", "observation_text", "returncode")


@query("raw_run_summary", _RAW + """
SELECT trajectory_id, instance_id, model_name, CAST(CASE shape WHEN 5 THEN 0 WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS n_total_steps, y_fail FROM ids""")
def raw_run_summary(spark, sf):
    return N.normalize(raw_runs(spark, sf))[0]


@query("raw_run_ids", _RAW + """
SELECT substr(sha1(concat(instance_id, chr(31), coalesce(model_name, '?'), chr(31), substr(sha1(trajectory), 1, 10))), 1, 12) AS trajectory_id,
  count(*) AS copies, count(DISTINCT ok) AS outcomes FROM raw GROUP BY 1""")
def raw_run_ids(spark, sf):
    r = raw_runs(spark, sf)
    return r.groupBy(N.run_id(F.col("instance_id"), F.col("model_name"), F.col("trajectory")).alias("trajectory_id")).agg(
        F.count(F.lit(1)).alias("copies"), F.count_distinct(F.col("turn") % 2).alias("outcomes"))


@query("payload_shapes", "WITH s AS (SELECT (conv_id + turn) % 6 AS shape FROM conversations)" + """
SELECT CAST(shape IN (0, 2, 3, 4) AS BIGINT) AS turn_shape, CAST([2, 7, 1, 1, 1, 0][shape + 1] AS BIGINT) AS n_items, count(*) AS n FROM s GROUP BY ALL""")
def payload_shapes(spark, sf):
    items = N.payload_items(F.col("trajectory"))
    r = raw_runs(spark, sf).select(items.alias("items"))
    return r.groupBy(N.is_turn_shape(F.col("items")).cast("bigint").alias("turn_shape"),
                     F.size("items").cast("bigint").alias("n_items")).agg(F.count(F.lit(1)).alias("n"))


@query("success_flags", """
SELECT 'number' AS source, CAST(quality <> 0 AS BIGINT) AS success, count(*) AS n FROM labels GROUP BY ALL
UNION ALL SELECT 'boolean', CAST(quality = 1 AS BIGINT), count(*) FROM labels GROUP BY ALL
UNION ALL SELECT 'word', CAST(doc_id % 4 IN (0, 2) AS BIGINT), count(*) FROM labels GROUP BY ALL""")
def success_flags(spark, sf):
    x = S.table(spark, sf, "labels")
    word = F.element_at(F.array(F.lit(" Resolved"), F.lit("no"), F.lit("PASSED"), F.lit("0")),
                        (F.col("doc_id") % 4 + 1).cast("int"))
    flags = x.select(F.explode(F.array(
        F.struct(F.lit("number").alias("source"), N.success_flag(F.col("quality"), "int").alias("ok")),
        F.struct(F.lit("boolean").alias("source"), N.success_flag(F.col("quality") == 1, "boolean").alias("ok")),
        F.struct(F.lit("word").alias("source"), N.success_flag(word, "string").alias("ok")))).alias("f"))
    return flags.groupBy("f.source", F.col("f.ok").cast("bigint").alias("success")).agg(F.count(F.lit(1)).alias("n"))


@query("raw_projection", """
SELECT CAST(conv_id AS VARCHAR) AS instance_id, role AS model_name, CAST(turn AS VARCHAR) AS target,
  concat('[{"role":"', role, '","turn":', turn, '}]') AS trajectory,
  CAST(NULL AS VARCHAR) AS exit_status, CAST(NULL AS VARCHAR) AS generated_patch, CAST(NULL AS VARCHAR) AS eval_logs FROM conversations""")
def raw_projection(spark, sf):
    m = S.table(spark, sf, "conversations")
    return N.project_raw(m.select(
        F.col("conv_id").cast("string").alias("instance_id"), F.col("role").alias("model_name"),
        F.col("turn").cast("string").alias("target"),
        F.array(F.struct("role", "turn")).alias("trajectory"), "text"))


@query("label_scan", "SELECT doc_id AS instance_id, CAST(quality AS BIGINT) AS target FROM labels")
def label_scan(spark, sf):
    """Two columns of a wide table; only they are read."""
    return S.table(spark, sf, "labels").select(F.col("doc_id").alias("instance_id"), F.col("quality").cast("bigint").alias("target"))


# ---------------------------------------------------------------- tool-call logs


def tool_messages(spark, sf):
    """Conversations as tool-call logs: assistant turns call one of four tools, users answer."""
    m = S.messages(spark, sf)
    pos, h = F.col("pos"), F.substring(F.md5("text"), 1, 6)
    kind = (F.col("run") + F.floor(pos / 2)) % 4
    name = F.element_at(F.array(*[F.lit(n) for n in ("think", "execute_bash", "str_replace_editor", "finish")]),
                        (kind + 1).cast("int"))
    arguments = (F.when(kind == 1, F.concat(F.lit('{"command":"ls '), h, F.lit('"}')))
                 .when(kind == 2, F.concat(F.lit('{"command":"'), F.when(pos % 3 == 0, "view").when(pos % 3 == 1, "insert").otherwise("undo_edit"),
                                           F.lit('","path":"src/'), h, F.lit('.py"}')))
                 .otherwise(F.lit("{}")))
    assistant = F.col("role") == "assistant"
    call = F.struct(F.concat(F.lit("c"), pos.cast("string")).alias("id"), name.alias("name"), arguments.alias("arguments"))
    return m.select(
        F.col("run").cast("string").alias("trajectory_id"), "pos",
        F.when(assistant, "assistant").otherwise("tool").alias("role"),
        F.when(assistant, F.concat(F.lit("say "), h)).otherwise(F.col("text")).alias("content"),
        F.when(~assistant, F.concat(F.lit("c"), (pos - 1).cast("string"))).alias("tool_call_id"),
        F.when(assistant, F.array(call)).alias("tool_calls"))


_TOOL = "WITH " + S.SQL["messages"] + """,
calls AS (
  SELECT CAST(run AS VARCHAR) AS trajectory_id, pos, (run + pos // 2) % 4 AS kind, substr(md5(text), 1, 6) AS h FROM messages WHERE role = 'assistant'),
marked AS (
  SELECT *, coalesce(sum(CAST(kind <> 0 AS BIGINT)) OVER (PARTITION BY trajectory_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn FROM calls),
tool_turns AS (
  SELECT trajectory_id, CAST(turn AS BIGINT) AS step_index, string_agg(concat('say ', h), ' ' ORDER BY pos) AS thought_text,
    max(pos) FILTER (kind <> 0) AS call_pos,
    any_value(CASE kind WHEN 1 THEN concat('ls ', h) WHEN 3 THEN 'submit'
      WHEN 2 THEN CASE pos % 3 WHEN 0 THEN concat('open src/', h, '.py') WHEN 1 THEN concat('insert 1 src/', h, '.py') ELSE concat('edit 1:1 src/', h, '.py') END END) FILTER (kind <> 0) AS action_text
  FROM marked GROUP BY ALL HAVING max(pos) FILTER (kind <> 0) IS NOT NULL),
tool_steps AS (
  SELECT t.* EXCLUDE (call_pos), left(coalesce(m.text, ''), 8000) AS observation_text FROM tool_turns t
  LEFT JOIN messages m ON CAST(m.run AS VARCHAR) = trajectory_id AND m.pos = call_pos + 1 AND m.role <> 'assistant')"""


@query("tool_log_turns", _TOOL + " SELECT * FROM tool_steps")
def tool_log_turns(spark, sf):
    return by_run_length(tool_messages(spark, sf), N.tool_turns, position="pos")


@query("tool_log_selection", _TOOL + """,
sizes AS (SELECT trajectory_id, count(*) AS n_total_steps, concat('i', CAST(trajectory_id AS BIGINT) % 5) AS instance_id FROM tool_steps GROUP BY 1 HAVING count(*) >= 2)
SELECT trajectory_id, instance_id, n_total_steps FROM sizes QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY trajectory_id) <= 3""")
def tool_log_selection(spark, sf):
    turns = tool_log_turns(spark, sf)
    runs = turns.select("trajectory_id").distinct().withColumn(
        "instance_id", F.concat(F.lit("i"), (F.col("trajectory_id").cast("bigint") % 5).cast("string")))
    return N.select_tool_runs(turns, runs, min_turns=2).select("trajectory_id", "instance_id", "n_total_steps")


# ---------------------------------------------------------------- profile


@query("dataset_profile", "WITH " + CLASSIFIED + """,
lens AS (SELECT list(n_total_steps ORDER BY n_total_steps) AS l, count(*) AS n FROM runs)
SELECT 'n_steps' AS section, key, CAST(value AS DOUBLE) AS value FROM (
  SELECT 'min' AS key, l[1] AS value FROM lens UNION ALL SELECT 'max', l[n] FROM lens
  UNION ALL SELECT 'p50', l[least(n, CAST(floor(0.5 * n) AS BIGINT) + 1)] FROM lens
  UNION ALL SELECT 'p90', l[least(n, CAST(floor(0.9 * n) AS BIGINT) + 1)] FROM lens
  UNION ALL SELECT 'p99', l[least(n, CAST(floor(0.99 * n) AS BIGINT) + 1)] FROM lens
  UNION ALL SELECT 'mean', round(list_avg(l), 6) FROM lens UNION ALL SELECT 'n_empty', 0 FROM lens)
UNION ALL SELECT 'label_balance', CAST(y_fail AS VARCHAR), count(*) FROM runs GROUP BY 2
UNION ALL SELECT 'model_name_counts', model_name, count(*) FROM runs GROUP BY 2
UNION ALL SELECT 'action_type_counts', kind, count(*) FROM classified GROUP BY 2""")
def dataset_profile(spark, sf):
    steps = S.steps(spark, sf)
    return rounded(N.profile(S.runs(steps), classify(steps), ["model_name"]))


@query("column_type_profile", """
SELECT 'doc_id' AS "column", 'bigint' AS type, count(*) AS n FROM labels UNION ALL
SELECT 'quality', CASE WHEN quality = 0 THEN 'missing' ELSE 'int' END, count(*) FROM labels GROUP BY 2 UNION ALL
SELECT 'toxic', 'int', count(*) FROM labels""")
def column_type_profile(spark, sf):
    x = S.table(spark, sf, "labels")
    return N.type_profile(x.withColumn("quality", F.when(F.col("quality") != 0, F.col("quality"))))


# ---------------------------------------------------------------- text


@query("url_file_paths", f"""
SELECT page_id, list_distinct(regexp_extract_all(url, {quoted(P.FILE_PATH)}, 1))[1] AS first_path,
  len(list_distinct(regexp_extract_all(url, {quoted(P.FILE_PATH)}, 1))) AS n_paths,
  len(list_distinct(regexp_extract_all(url, {quoted(P.FILE_PATH_LONGEST)}, 1))) AS n_paths_longest FROM pages
WHERE len(regexp_extract_all(url, {quoted(P.FILE_PATH)}, 1)) < 2
UNION ALL SELECT page_id, regexp_extract(url, {quoted(P.FILE_PATH)}, 1), len(list_distinct(regexp_extract_all(url, {quoted(P.FILE_PATH)}, 1))),
  len(list_distinct(regexp_extract_all(url, {quoted(P.FILE_PATH_LONGEST)}, 1))) FROM pages WHERE len(regexp_extract_all(url, {quoted(P.FILE_PATH)}, 1)) >= 2""")
def url_file_paths(spark, sf):
    u = F.col("url")
    return S.table(spark, sf, "pages").select(
        "page_id", F.get(T.file_paths(u), F.lit(0)).alias("first_path"),
        F.size(T.file_paths(u)).cast("bigint").alias("n_paths"),
        F.size(T.file_paths(u, longest_extension=True)).cast("bigint").alias("n_paths_longest"))


@query("document_first_lines", f"""
SELECT doc_id, left(list_filter(list_transform(string_split_regex(text, {quoted(chr(92) + 'r?' + chr(92) + 'n|' + chr(92) + 'r')}),
    lambda x: trim({strip_sql('x')}, '`')), lambda x: x <> '' AND NOT starts_with(x, '#'))[1], 300) AS command,
  left(trim(regexp_replace({strip_sql('text')}, '\\s+', ' ', 'g')), 40) AS short_text FROM documents""")
def document_first_lines(spark, sf):
    t = F.col("text")
    return S.table(spark, sf, "documents").select(
        "doc_id", T.first_command(t).alias("command"), T.clip(t, 40).alias("short_text"))


@query("test_report_counts", """
WITH r AS (SELECT doc_id, doc_id % 7 AS f, doc_id % 11 AS p, doc_id % 4 AS shape FROM documents)
SELECT doc_id, CASE shape WHEN 0 THEN p WHEN 1 THEN 0 WHEN 2 THEN 2 END AS passed,
  CASE shape WHEN 0 THEN f + 2 WHEN 1 THEN f WHEN 2 THEN 1 END AS failed,
  CAST(shape = 3 AS BIGINT) AS traceback, CAST(shape = 3 AS BIGINT) AS exception FROM r""")
def test_report_counts(spark, sf):
    """Test counts read from reports attached to documents in four shapes."""
    d = S.table(spark, sf, "documents").select("doc_id")
    f, p = (F.col("doc_id") % 7).cast("string"), (F.col("doc_id") % 11).cast("string")
    report = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(f, F.lit(" failed, "), p, F.lit(" Passed, 2 errors in 1s")))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("ran: "), f, F.lit(" FAILED")))
        .when(F.col("doc_id") % 4 == 2, F.lit("PASSED a\nPASSED b\nFAILED tests/x\nall FAILED"))
        .otherwise(F.lit("Traceback (most recent call last):\n  MyError: x")))
    d = d.withColumn("report", report)
    passed, failed = T.test_counts(F.col("report"))
    return d.select("doc_id", passed.alias("passed"), failed.alias("failed"),
                    T.has_traceback(F.col("report")).cast("bigint").alias("traceback"),
                    T.has_exception(F.col("report")).cast("bigint").alias("exception"))


@query("code_blocks_and_outputs", f"""
WITH t AS (SELECT conv_id, turn, text, concat('a', chr(10), '```python', chr(10), text, chr(10), '```', chr(10), '```', chr(10), 'x = ', turn, chr(10), '```') AS gen FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN concat('x = ', turn) ELSE {strip_sql(f"trim({strip_sql('text')}, '`')")} END AS code,
  concat('out ', turn, chr(10), chr(10), 'end') AS output FROM t""")
def code_blocks_and_outputs(spark, sf):
    c, turn = S.table(spark, sf, "conversations"), F.col("turn").cast("string")
    gen = F.when(F.col("turn") % 2 == 0, F.concat(
        F.lit("a\n```python\n"), F.col("text"), F.lit("\n```\n```\nx = "), turn, F.lit("\n```"))).otherwise(F.col("text"))
    out = F.concat(F.lit("\n\nout "), turn, F.lit("  \n\t\nend \n\n"))
    return c.select("conv_id", "turn", T.last_code_block(gen).alias("code"), T.normalized_output(out).alias("output"))


@query("command_verbs", "WITH " + S.SQL["steps"] + """,
c AS (SELECT trajectory_id, step_index, action_text AS cmd, lead(action_text) OVER (PARTITION BY trajectory_id ORDER BY step_index) AS nxt FROM steps)
SELECT trajectory_id, step_index,
  CASE WHEN split_part(cmd, ' ', 1) IN ('cat', 'ls') THEN 'investigate' WHEN split_part(cmd, ' ', 1) IN ('sed', 'python') THEN 'act' ELSE 'other' END AS verb_class,
  CASE WHEN nxt = cmd THEN 'persist' WHEN split_part(nxt, ' ', 1) IN ('cat', 'ls', 'sed', 'python') THEN 'recover' ELSE 'other' END AS next_class,
  CAST(NOT coalesce(left(nxt, 15) = left(cmd, 15), false) AS BIGINT) AS escaped
FROM c WHERE nxt IS NOT NULL""")
def command_verbs(spark, sf):
    """Class of every command and of what follows it."""
    def job(part, scan):
        s = scan.apply(part.select("trajectory_id", "step_index", "action_text"), looped=previous(F.col("action_text")))
        return s.where(F.col("looped").isNotNull()).select(
            "trajectory_id", (F.col("step_index") - 1).alias("step_index"),
            T.verb_class(F.col("looped")).alias("verb_class"),
            T.next_command_class(F.col("action_text"), F.col("looped")).alias("next_class"),
            (~T.repeats_command(F.col("action_text"), F.col("looped"))).cast("bigint").alias("escaped"))

    return by_run_length(S.steps(spark, sf), job)


@query("reply_commands", "WITH " + S.SQL["steps"] + """
SELECT trajectory_id, step_index, action_text AS command FROM steps""")
def reply_commands(spark, sf):
    """Commands found in three forms of model replies."""
    s = S.steps(spark, sf)
    a = F.col("action_text")
    reply = (F.when(F.col("step_index") % 3 == 0, F.concat(F.lit("<think>`no`</think>I will run `"), a, F.lit("` now")))
             .when(F.col("step_index") % 3 == 1, F.concat(F.lit("Here is it:\n"), a, F.lit("\nthanks")))
             .otherwise(a))
    return s.select("trajectory_id", "step_index", T.reply_command(reply).alias("command"))


@query("repository_names", "WITH " + S.SQL["events"] + """
SELECT DISTINCT instance_id, regexp_replace(instance_id, '-[^-]*$', '') AS repo FROM runs""")
def repository_names(spark, sf):
    return S.event_log(spark, sf).select("instance_id", T.repository(F.col("instance_id")).alias("repo")).distinct()


@query("test_path_flags", "WITH " + CLASSIFIED + """
SELECT file, count(*) AS n, CAST(file LIKE 'tests/%' AS BIGINT) AS is_test FROM (SELECT unnest(files) AS file FROM classified) GROUP BY file""")
def test_path_flags(spark, sf):
    paths = S.steps(spark, sf).select(F.explode(T.file_paths(F.col("action_text"))).alias("file"))
    return paths.groupBy("file").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "is_test", T.is_test_path(F.col("file")).cast("bigint"))


@query("hard_recent_problems", """
SELECT o_orderkey AS problem_id, o_orderpriority AS difficulty, strftime(o_orderdate, '%Y-%m') AS month FROM orders
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND strftime(o_orderdate, '%Y-%m') >= '1998-06' ORDER BY o_orderkey LIMIT 500""")
def hard_recent_problems(spark, sf):
    """Problems of given difficulty and date, the first 500 by id (a top-k report)."""
    o = S.table(spark, sf, "orders").where(
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderdate") >= F.lit("1998-06-01").cast("timestamp")))
    return o.orderBy("o_orderkey").limit(500).select(
        F.col("o_orderkey").alias("problem_id"), F.col("o_orderpriority").alias("difficulty"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month"))


@query("steps_in_prefix", "WITH " + S.SQL["steps"] + """,
m AS (SELECT trajectory_id, CAST(20 + CAST(substr(trajectory_id, 2) AS BIGINT) % 10 AS BIGINT) AS prefix_step FROM runs)
SELECT trajectory_id, step_index, action_text FROM steps JOIN m USING (trajectory_id) WHERE step_index < prefix_step""")
def steps_in_prefix(spark, sf):
    """Steps that belong to one chosen prefix per run (equi-join with a range condition)."""
    s = S.steps(spark, sf)
    chosen = S.runs(s).select("trajectory_id", (20 + F.substring("trajectory_id", 2, 20).cast("bigint") % 10).alias("prefix_step"))
    return s.join(chosen, "trajectory_id").where("step_index < prefix_step").select("trajectory_id", "step_index", "action_text")
