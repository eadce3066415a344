"""Raw run logs of several dialects to one row per step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trailcast.functions import patterns as P
from trailcast.functions import text as T
from trailcast.operators.ordering import attach, number_rows, running_total
from trailcast.operators.sampling import first_per_group
from trailcast.operators.scan import RunScan, last_before, last_seen, running_sum
from trailcast.session import cut_lineage

TEXT_LIMIT = 8000
RAW_COLUMNS = ["instance_id", "model_name", "target", "trajectory", "exit_status", "generated_patch", "eval_logs"]


def success_flag(value: Column, kind: str) -> Column:
    """Success boolean from a boolean, number or word column of SQL type ``kind``."""
    if kind == "boolean":
        return F.coalesce(value, F.lit(False))
    if kind in ("string", "variant"):
        return F.coalesce(F.lower(T.strip(value.cast("string"))).isin(P.TRUTHY_WORDS), F.lit(False))
    return F.coalesce(value != 0, F.lit(False))


def project_raw(raw: DataFrame) -> DataFrame:
    """The seven kept columns; missing ones become NULL, nested logs become JSON text."""
    types = dict(raw.dtypes)

    def keep(name: str) -> Column:
        if name not in types:
            return F.lit(None).cast("string").alias(name)
        if name == "trajectory" and types[name].startswith(("array", "struct", "map")):
            return F.to_json(name).alias(name)
        return F.col(name)

    return raw.select(*[keep(c) for c in RAW_COLUMNS])


def run_id(instance: Column, model: Column, content: Column) -> Column:
    """Id from instance, model and content, so that repeated attempts stay apart."""
    signature = F.substring(F.sha1(F.coalesce(content, F.lit(""))), 1, 10)
    return T.short_id(instance, T.or_empty(model, F.lit("?")), signature)


def payload_items(trajectory: Column) -> Column:
    """Array of JSON objects of a payload of any accepted shape."""
    text = T.strip(trajectory)
    v = F.try_parse_json(text)

    def is_object(x: Column) -> Column:
        return F.schema_of_variant(x).startswith("OBJECT")

    listed = F.coalesce(*[F.try_variant_get(v, path, "array<variant>")
                          for path in ("$", "$.trajectory", "$.history", "$.steps", "$.messages")])
    note = F.parse_json(F.to_json(F.struct(text.alias("observation"))))
    none = F.array().cast("array<variant>")
    return (
        F.when(text == "", none)
        .when(v.isNull(), F.array(note))
        .when(listed.isNotNull(), F.filter(listed, lambda x: x.isNotNull() & is_object(x)))
        .when(is_object(v), F.array(v))
        .otherwise(none))


def has_key(item: Column, *keys: str) -> Column:
    fields = F.try_variant_get(item, "$", "map<string,variant>")
    found = F.lit(False)
    for k in keys:
        found = found | F.coalesce(F.map_contains_key(fields, k), F.lit(False))
    return found


def is_turn_shape(items: Column) -> Column:
    return F.exists(items, lambda x: has_key(x, "action", "observation"))


def _field(item: str, *names: str) -> Column:
    return T.or_empty(*[F.try_variant_get(F.col(item), f"$.{n}", "string") for n in names])


def steps_of_turns(items: DataFrame) -> DataFrame:
    """Steps of logs whose items already are turns (``item`` variant, ``pos``)."""
    return items.select(
        "trajectory_id", F.col("pos").cast("bigint").alias("step_index"),
        F.try_variant_get("item", "$.role", "string").alias("role"),
        _field("item", "thought").alias("thought_text"),
        _field("item", "action", "response").alias("action_text"),
        _field("item", "observation").alias("observation_text"),
        F.try_variant_get("item", "$.returncode", "bigint").alias("returncode"))


def pair_messages(messages: DataFrame, scan: RunScan, starts: list[str] | None = None,
                  stops: list[str] | None = None) -> DataFrame:
    """One step per assistant message; the messages up to the next one are its observation.

    ``messages`` has (trajectory_id, pos, role, text). Observations keep 8000 characters,
    so only the messages within that many characters after their assistant message are
    gathered, however many follow. After a ``stops`` role nothing is gathered.
    """
    role = F.lower(F.coalesce(F.col("role"), F.lit("")))
    begins = role.isin(starts or P.ASSISTANT_ROLES)
    ends = role.isin(stops) if stops else F.lit(False)
    m = messages.select(
        "trajectory_id", "pos", T.or_empty(F.col("text")).alias("text"), begins.alias("begins"),
        F.when(begins, True).when(ends, False).alias("open"))
    size = F.when(F.col("begins") | (F.col("text") == ""), 0).otherwise(F.length("text") + 1).cast("bigint")
    m = m.withColumn("size", size)
    m = scan.apply(m, turn=running_sum(F.col("begins").cast("bigint")), upto=running_sum(F.col("size")),
                   opened=last_seen(F.col("open")))
    m = scan.apply(m, base=last_seen(F.when(F.col("begins"), F.col("upto"))))
    near = F.col("upto") - F.col("size") - F.col("base") < TEXT_LIMIT
    part = F.when(~F.col("begins") & F.col("opened") & (F.col("size") > 0) & near,
                  F.struct("pos", T.head(F.col("text"), TEXT_LIMIT).alias("text")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"]), "\n")
    return m.where(F.col("turn") > 0).groupBy("trajectory_id", (F.col("turn") - 1).alias("step_index")).agg(
        F.max(F.when(F.col("begins"), F.col("pos"))).alias("pos"),
        F.max(F.when(F.col("begins"), F.col("text"))).alias("raw_text"),
        joined.alias("observation_text"))


def cut_texts(steps: DataFrame) -> DataFrame:
    columns = [c for c in ("raw_text", "thought_text", "action_text", "observation_text") if c in steps.columns]
    return steps.withColumns({c: T.head(T.or_empty(F.col(c)), TEXT_LIMIT) for c in columns})


def steps_of_chat(messages: DataFrame, scan: RunScan) -> DataFrame:
    """Steps of a chat log: pairing, then thought and action from the assistant text."""
    paired = pair_messages(messages, scan)
    thought, action = T.split_message(F.col("raw_text"))
    return cut_texts(paired.withColumns({"thought_text": thought, "action_text": action}).drop("pos"))


def steps_of_live_log(messages: DataFrame, scan: RunScan) -> DataFrame:
    """Steps of a live agent log: commands come with the message, injected messages are ignored.

    ``messages`` has (trajectory_id, pos, role, content, commands array, injected).
    """
    kept = messages.where(~F.coalesce(F.col("injected"), F.lit(False)) | (F.lower("role") == "assistant"))
    paired = pair_messages(kept.withColumnRenamed("content", "text"), scan, ["assistant"], ["exit"])
    commands = messages.select("trajectory_id", "pos", F.array_join("commands", "\n").alias("commands"))
    return cut_texts(paired.join(commands, ["trajectory_id", "pos"]).select(
        "trajectory_id", "step_index", F.col("raw_text").alias("thought_text"),
        T.or_empty(F.col("commands"), F.col("raw_text")).alias("action_text"), "observation_text"))


def normalize(raw: DataFrame, scan: RunScan | None = None) -> tuple[DataFrame, DataFrame]:
    """(runs, steps) of raw logs. Rows that cannot be read become runs without steps.

    Every raw row is a run. Rows with the same instance, model and content are attempts, successes
    first: the second gets the id with "-2" after it, and so on.
    """
    scan = scan or RunScan(position="pos")
    kind = dict(raw.dtypes)["target"]
    r = project_raw(raw).withColumns({
        "trajectory_id": run_id(F.col("instance_id"), F.col("model_name"), F.col("trajectory")),
        "y_fail": (~success_flag(F.col("target"), kind)).cast("bigint"), "_row": F.monotonically_increasing_id()})
    # Attempts are counted in blocks of 65,536 row numbers, so a log repeated in most rows is spread.
    block = F.col("y_fail") * (1 << 48) + F.shiftright("_row", 16)
    r = number_rows(cut_lineage(r), [F.col("y_fail"), F.col("_row")], block, "attempt", ["trajectory_id"])
    r = r.withColumn("trajectory_id", F.when(F.col("attempt") == 1, F.col("trajectory_id")).otherwise(
        F.concat("trajectory_id", F.lit("-"), F.col("attempt").cast("string")))).drop("_row", "attempt")
    r = r.withColumn("items", payload_items(F.col("trajectory"))).withColumn(
        "turns", is_turn_shape(F.col("items")))
    items = r.select("trajectory_id", "turns", F.posexplode("items").alias("pos", "item"))
    chat = items.where(~F.col("turns")).select(
        "trajectory_id", "pos", F.try_variant_get("item", "$.role", "string").alias("role"),
        _field("item", "content", "text").alias("text"))
    turn_steps = cut_texts(steps_of_turns(items.where("turns")))
    chat_steps = steps_of_chat(chat, scan).select(
        "trajectory_id", "step_index", F.lit("assistant").alias("role"), "thought_text", "action_text",
        "observation_text", F.lit(None).cast("bigint").alias("returncode"))
    meta = r.select("trajectory_id", "instance_id", "model_name", "y_fail")
    steps = turn_steps.unionByName(chat_steps).join(meta.drop("y_fail"), "trajectory_id")
    sizes = steps.groupBy("trajectory_id").agg(F.count(F.lit(1)).alias("n"))
    runs = meta.join(sizes, "trajectory_id", "left").select(
        "trajectory_id", "instance_id", "model_name", F.coalesce("n", F.lit(0)).alias("n_total_steps"), "y_fail")
    return runs, steps


# ---------------------------------------------------------------- tool-call logs


TOOL_MESSAGES = ("array<struct<role:string,content:string,tool_call_id:string,"
                 "tool_calls:array<struct<id:string,function:struct<name:string,arguments:string>>>>>")


def read_tool_log(raw: DataFrame) -> DataFrame:
    """Messages of raw rows (ds JSON, messages JSON, reward)."""
    r = raw.select(
        F.get_json_object("ds", "$.instance_id").alias("instance_id"),
        (F.col("reward").cast("double") >= 0.5).alias("target"),
        T.short_id(F.get_json_object("ds", "$.instance_id"), F.col("messages")).alias("trajectory_id"),
        F.posexplode(F.from_json("messages", TOOL_MESSAGES)).alias("pos", "m"))
    return r.select("trajectory_id", "instance_id", "target", "pos", "m.role", "m.content", "m.tool_call_id",
                    F.transform("m.tool_calls", lambda c: F.struct(
                        c["id"].alias("id"), c["function"]["name"].alias("name"),
                        c["function"]["arguments"].alias("arguments"))).alias("tool_calls"))


def call_action(name: Column, arguments: Column) -> Column:
    """Action text of a tool call in the words the step classifier knows."""
    def arg(key: str, default: str = "") -> Column:
        return F.coalesce(F.get_json_object(arguments, f"$.{key}"), F.lit(default))

    sub, path = arg("command"), arg("path")
    # Editor sub-commands and the words they become.
    editor = (
        F.when(sub == "view", F.concat(F.lit("open "), path))
        .when(sub == "create", F.concat(F.lit("create "), path))
        .when(sub == "str_replace", F.concat(F.lit("str_replace "), path))
        .when(sub == "undo_edit", F.concat(F.lit("edit 1:1 "), path))
        .when(sub == "insert", F.concat(F.lit("insert "), arg("insert_line", "1"), F.lit(" "), path))
        .otherwise(F.concat(sub, F.lit(" "), path)))
    return (F.when(name == "execute_bash", arg("command")).when(name == "str_replace_editor", editor)
            .when(name == "finish", F.lit("submit")).otherwise(F.lit("")))


def tool_turns(messages: DataFrame, scan: RunScan) -> DataFrame:
    """Turns of a tool-call log: thinking-only turns join the thought of the next real call.

    ``messages`` has (trajectory_id, pos, role, content, tool_call_id, tool_calls).
    """
    a = messages.where(F.col("role") == "assistant").select(
        "trajectory_id", "pos", T.or_empty(F.col("content")).alias("thought"),
        F.get(F.filter(F.coalesce("tool_calls", F.array().cast(
            "array<struct<id:string,name:string,arguments:string>>")),
            lambda c: F.coalesce(c["name"], F.lit("")) != "think"), F.lit(0)).alias("call"))
    real = F.col("call").isNotNull()
    size = F.when(T.strip(F.col("thought")) == "", 0).otherwise(F.length(T.strip(F.col("thought"))) + 1).cast("bigint")
    a = scan.apply(a, upto=running_sum(size), done=running_sum(real.cast("bigint")))
    a = a.withColumn("turn", F.when(real, F.col("done") - 1).otherwise(F.col("done")))
    a = scan.apply(a, base=last_before(F.when(real, F.col("upto"))))
    used = F.col("upto") - size - F.coalesce(F.col("base"), F.lit(0))
    # Blank thoughts leave no trace, so dropping them bounds the list by the characters kept.
    part = F.when((used < TEXT_LIMIT) & (T.strip(F.col("thought")) != ""),
                  F.struct("pos", F.col("thought").alias("t")))
    thoughts = F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"])
    folded = F.aggregate(thoughts, F.lit(""), lambda acc, t: T.strip(F.concat(acc, F.lit(" "), t)))
    turns = a.groupBy("trajectory_id", F.col("turn").alias("step_index")).agg(
        folded.alias("thought_text"), F.max(F.when(real, F.col("call"))).alias("call")).where("call IS NOT NULL")
    answers = messages.where((F.col("role") == "tool") & (T.or_empty(F.col("tool_call_id")) != "")).groupBy(
        "trajectory_id", F.col("tool_call_id").alias("call_id")).agg(
        F.max_by(T.or_empty(F.col("content")), "pos").alias("answer"))
    joined = turns.withColumn("call_id", F.col("call.id")).join(answers, ["trajectory_id", "call_id"], "left")
    return cut_texts(joined.select(
        "trajectory_id", "step_index", "thought_text",
        call_action(F.col("call.name"), F.col("call.arguments")).alias("action_text"),
        F.coalesce("answer", F.lit("")).alias("observation_text")))


def select_tool_runs(turns: DataFrame, runs: DataFrame, min_turns: int = 3, per_instance: int = 3,
                     limit: int | None = None) -> DataFrame:
    """Runs with enough turns, at most so many per instance, optionally capped overall."""
    sizes = turns.groupBy("trajectory_id").agg(F.count(F.lit(1)).alias("n_total_steps"))
    long_enough = runs.join(sizes.where(F.col("n_total_steps") >= min_turns), "trajectory_id")
    kept = first_per_group(long_enough, ["instance_id"], per_instance, [F.col("trajectory_id")])
    return kept if limit is None else kept.orderBy("instance_id", "trajectory_id").limit(limit)


# ---------------------------------------------------------------- profile


def profile(runs: DataFrame, steps: DataFrame, categories: list[str]) -> DataFrame:
    """Tidy (section, key, value): label balance, frequent values, run lengths, action types.

    Run-length quantiles are nearest-rank over the histogram of lengths.
    """
    def tidy(df: DataFrame, section: str, key: Column, value: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), key.cast("string").alias("key"),
                         value.cast("double").alias("value"))

    h = runs.groupBy("n_total_steps").agg(F.count(F.lit(1)).alias("n"))
    run = running_total(h, "n_total_steps", ["n"], F.floor(F.col("n_total_steps") / 256).cast("bigint"))
    total = h.agg(F.sum("n").alias("total"), F.min("n_total_steps").alias("lo"), F.max("n_total_steps").alias("hi"),
                  (F.sum(F.col("n") * F.col("n_total_steps")) / F.sum("n")).alias("mean"))
    placed = attach(run, total)

    def rank(p: float) -> Column:
        i = F.least(F.col("total") - 1, F.floor(F.lit(p) * F.col("total")))
        return F.max(F.when((i >= F.col("n_before")) & (i < F.col("n_before") + F.col("n")), F.col("n_total_steps")))

    lengths = placed.agg(*[rank(p).alias(k) for k, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))],
                         F.max("lo").alias("min"), F.max("hi").alias("max"), F.max("mean").alias("mean"),
                         F.sum(F.when(F.col("n_total_steps") == 0, F.col("n")).otherwise(0)).alias("n_empty"))
    names = ["min", "p50", "p90", "p99", "max", "mean", "n_empty"]
    unpivoted = lengths.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("key"), F.col(n).cast("double").alias("value")) for n in names])))
    out = tidy(unpivoted, "n_steps", F.col("key"), F.col("value"))
    out = out.unionByName(tidy(runs.groupBy("y_fail").count(), "label_balance", F.col("y_fail"), F.col("count")))
    for c in categories:
        top = runs.groupBy(c).count().orderBy(F.col("count").desc(), c).limit(20)
        out = out.unionByName(tidy(top, f"{c}_counts", F.col(c), F.col("count")))
    return out.unionByName(tidy(
        steps.groupBy("action_type").count(), "action_type_counts", F.col("action_type"), F.col("count")))


def type_profile(df: DataFrame) -> DataFrame:
    """(column, type, n): how often each column has a value of which type, or none. One pass."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.when(F.col(c).isNull(), "missing").otherwise(t).alias("type"))
        for c, t in df.dtypes])).alias("x")).groupBy("x.column", "x.type").agg(F.count(F.lit(1)).alias("n"))
