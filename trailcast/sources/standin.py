"""Run-log tables derived from the general test tables.

``events`` play the steps of runs, ``conversations`` the chat logs, ``embeddings``
the activation vectors, ``lineitem`` the samples per problem and ``orders`` the
paired runs. Each DataFrame function has a SQL twin in :data:`SQL`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from trailcast.operators import prefixes as PX
from trailcast.operators.ordering import number_rows
from trailcast.operators.scan import by_run_length, long_runs, running_sum


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Events that one task numbers and scans, about, however many there are.
PART_ROWS = 25_000


#: Samples that one task numbers and compares, about.
PART_SAMPLES = 250_000


def in_parts(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Whole keys in parts of about ``size`` rows. Adaptive execution merges parts by bytes as they are
    shuffled, and rows of a scan grow manyfold after that; a few rows are left to it."""
    parts = -(-rows.count() // size)
    if parts <= rows.sparkSession.sparkContext.defaultParallelism:
        return rows
    return rows.repartition(parts, key)


def parts_by_run(events: DataFrame) -> DataFrame:
    return in_parts(events, "trajectory_id", PART_ROWS)


def event_log(spark: SparkSession, sf_dir: str, hot_rows: int = 1_000_000) -> DataFrame:
    """Events numbered inside their run. An over-long run is numbered hour by hour."""
    ev = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), "user_id").alias("trajectory_id"),
        "user_id", "ts", "event_id", "event_type", "value",
        F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"))
    if long_runs(ev, limit=hot_rows).isEmpty():
        w = Window.partitionBy("trajectory_id").orderBy("ts", "event_id")
        out = parts_by_run(ev).withColumn("step_index", (F.row_number().over(w) - 1).cast("bigint"))
    else:
        out = number_rows(ev, [F.col("ts"), F.col("event_id")], F.date_trunc("hour", "ts"),
                          "step_index", by=["trajectory_id"])
        out = out.withColumn("step_index", F.col("step_index") - 1)
    g = F.floor(F.col("user_id") / 3).cast("bigint")
    return out.withColumns({
        "instance_id": F.concat(F.lit("org"), (g % 7).cast("string"), F.lit("__repo"),
                                (g % 4).cast("string"), F.lit("-"), g.cast("string")),
        "model_name": F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")),
    })


def steps(spark: SparkSession, sf_dir: str, hot_rows: int = 1_000_000) -> DataFrame:
    e = event_log(spark, sf_dir, hot_rows)
    k, kind = F.col("k"), F.col("event_type")

    def text(*parts) -> F.Column:
        return F.concat(*[p if isinstance(p, F.Column) else F.lit(p) for p in parts])

    def num(m: int) -> F.Column:
        return (k % m).cast("string")

    action = (
        F.when(kind == "view", text("cat src/f", num(9), ".py"))
        .when(kind == "click", text("rg sym", num(5)))
        .when(kind == "purchase", text("sed -i s/a/b/ src/f", num(9), ".py"))
        .when(kind == "error", text("python -m pytest tests/test_f", num(4), ".py"))
        .otherwise(F.lit("ls -la")))
    trace = F.when(k % 5 == 0, F.lit("\nTraceback (most recent call last)")).otherwise(F.lit(""))
    observation = (
        F.when(kind == "error", text(num(4), " failed, ", num(7), " passed", trace))
        .when(kind == "view", text("line ", num(11)))
        .otherwise(F.lit("")))
    return e.select(
        "trajectory_id", "instance_id", "model_name", "step_index",
        F.concat(F.lit("next "), kind).alias("thought_text"),
        action.alias("action_text"), observation.alias("observation_text"),
        "event_type", "ts", "event_id")


def runs(steps_or_events: DataFrame) -> DataFrame:
    """Label of each run: it fails when it has at least as many errors as purchases."""
    kind = F.col("event_type")
    return steps_or_events.groupBy("trajectory_id").agg(
        F.first("instance_id").alias("instance_id"), F.first("model_name").alias("model_name"),
        F.count(F.lit(1)).alias("n_total_steps"),
        (F.count(F.when(kind == "error", 1)) >= F.count(F.when(kind == "purchase", 1)))
        .cast("bigint").alias("y_fail"))


def risk(spark: SparkSession, sf_dir: str, every_step: bool = False) -> DataFrame:
    """A deterministic risk score per scheduled prefix (or per step), with many ties."""
    e = event_log(spark, sf_dir)
    kind = F.col("event_type")
    labels = runs(e)

    def job(part: DataFrame, scan) -> DataFrame:
        s = scan.apply(
            part.select("trajectory_id", "instance_id", "model_name", "step_index", "event_type"),
            n_test=running_sum((kind == "error").cast("bigint")),
            n_edit=running_sum((kind == "purchase").cast("bigint")))
        s = s.withColumns({
            "prefix_step": F.col("step_index") + 1,
            "risk": F.round(1 / (1 + F.exp(-(F.col("n_test") - F.col("n_edit")) / F.lit(3.0))), 6)})
        if every_step:
            out = s.join(labels.select("trajectory_id", "n_total_steps", "y_fail"), "trajectory_id")
            out = out.withColumn("prefix_id", PX.prefix_id(F.col("trajectory_id"), F.col("prefix_step")))
        else:
            out = PX.label_prefixes(s, labels)
        return out.select(*PX.META, "risk")

    return by_run_length(e, job)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("run"), F.col("turn").alias("pos"), "role", "text")


def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").alias("vec"), (F.col("label") % 3).cast("bigint").alias("cond"),
        (v % 8).alias("grp"), (20 + F.col("label") + v % 5).cast("bigint").alias("len"),
        (v % 4).alias("layer"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K samples per problem. The lines of one order are few, so its window is small."""
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus", "l_quantity")
    li = in_parts(lines, "l_orderkey", PART_SAMPLES).select(
        "l_orderkey", (F.row_number().over(w) - 1).cast("bigint").alias("k"),
        (F.col("l_returnflag") == "N").cast("bigint").alias("solved"),
        F.col("l_extendedprice").alias("score"),
        F.concat("l_linestatus", (F.col("l_quantity").cast("int") % 3).cast("string")).alias("signature"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("difficulty"))
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("l_orderkey").alias("problem_id"), "k", "solved", "score", "signature", "difficulty")


def paired_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First (baseline) and second (policy) order of every customer as two runs of one task."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 2)
    key = F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").alias("instance_id"),
        F.when(F.col("rn") == 1, F.lit("baseline")).otherwise(F.lit("policy")).alias("arm"),
        F.concat(F.lit("p"), (F.col("o_custkey") % 3).cast("string")).alias("policy"),
        F.concat(F.lit("model-"), (F.col("o_custkey") % 2).cast("string")).alias("model"),
        (F.col("o_orderstatus") == "F").cast("bigint").alias("success"),
        (1 + key % 40).alias("n_steps"), (key % 3).alias("n_interventions"),
        (key % 4).alias("n_loops"), F.col("o_totalprice").alias("runtime_s"),
        (key % 1000).alias("total_tokens_approx"), F.col("o_orderpriority").alias("difficulty"))


_EVENTS = """
events_n AS (
  SELECT concat('u', user_id) AS trajectory_id, user_id, ts, event_id, event_type, value,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS step_index,
    concat('org', (user_id // 3) % 7, '__repo', (user_id // 3) % 4, '-', user_id // 3) AS instance_id,
    concat('m', user_id % 3) AS model_name
  FROM events),
runs AS (
  SELECT trajectory_id, any_value(instance_id) AS instance_id, any_value(model_name) AS model_name,
    count(*) AS n_total_steps,
    CAST(count(*) FILTER (event_type = 'error') >= count(*) FILTER (event_type = 'purchase') AS BIGINT) AS y_fail
  FROM events_n GROUP BY trajectory_id)"""

_ON_SCHEDULE = "(step_index < 5 OR (step_index >= 9 AND (step_index + 1) % 5 = 0) OR step_index + 1 = n_total_steps)"

_RISK_STEPS = _EVENTS + """,
risk_steps AS (
  SELECT substr(sha1(concat(trajectory_id, chr(31), step_index + 1)), 1, 12) AS prefix_id,
    trajectory_id, e.instance_id, e.model_name, step_index, step_index + 1 AS prefix_step,
    n_total_steps, y_fail,
    round(1 / (1 + exp(-(
      count(*) FILTER (event_type = 'error') OVER w
      - count(*) FILTER (event_type = 'purchase') OVER w) / 3.0)), 6) AS risk
  FROM events_n e JOIN runs USING (trajectory_id)
  WINDOW w AS (PARTITION BY trajectory_id ORDER BY step_index ROWS UNBOUNDED PRECEDING))"""

# SQL twins, as leading CTE lists without the WITH keyword.
SQL = {
    "events": _EVENTS,
    "steps": _EVENTS + """,
steps AS (
  SELECT trajectory_id, instance_id, model_name, step_index, step_index + 1 AS step_no, event_type, ts, event_id,
    concat('next ', event_type) AS thought_text,
    CASE event_type
      WHEN 'view' THEN concat('cat src/f', k % 9, '.py')
      WHEN 'click' THEN concat('rg sym', k % 5)
      WHEN 'purchase' THEN concat('sed -i s/a/b/ src/f', k % 9, '.py')
      WHEN 'error' THEN concat('python -m pytest tests/test_f', k % 4, '.py')
      ELSE 'ls -la' END AS action_text,
    CASE WHEN event_type = 'error' THEN concat(k % 4, ' failed, ', k % 7, ' passed',
           CASE WHEN k % 5 = 0 THEN concat(chr(10), 'Traceback (most recent call last)') ELSE '' END)
         WHEN event_type = 'view' THEN concat('line ', k % 11) ELSE '' END AS observation_text
  FROM events_n)""",
    "risk_steps": _RISK_STEPS,
    "risk": _RISK_STEPS + f""",
risk AS (SELECT * FROM risk_steps WHERE {_ON_SCHEDULE})""",
    "messages": "messages AS (SELECT conv_id AS run, turn AS pos, role, text FROM conversations)",
    "activations": """activations AS (
  SELECT vec_id, embedding AS vec, CAST(label % 3 AS BIGINT) AS cond, vec_id % 8 AS grp,
    CAST(20 + label + vec_id % 5 AS BIGINT) AS len, vec_id % 4 AS layer FROM embeddings)""",
    "samples": """samples AS (
  SELECT l_orderkey AS problem_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS k,
    CAST(l_returnflag = 'N' AS BIGINT) AS solved, l_extendedprice AS score,
    concat(l_linestatus, CAST(l_quantity AS INT) % 3) AS signature, o_orderpriority AS difficulty
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "paired_runs": """ranked_orders AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders),
paired_runs AS (
  SELECT o_custkey AS instance_id, CASE WHEN rn = 1 THEN 'baseline' ELSE 'policy' END AS arm,
    concat('p', o_custkey % 3) AS policy, concat('model-', o_custkey % 2) AS model,
    CAST(o_orderstatus = 'F' AS BIGINT) AS success, 1 + o_orderkey % 40 AS n_steps,
    o_orderkey % 3 AS n_interventions, o_orderkey % 4 AS n_loops, o_totalprice AS runtime_s,
    o_orderkey % 1000 AS total_tokens_approx, o_orderpriority AS difficulty
  FROM ranked_orders WHERE rn <= 2)""",
}
ON_SCHEDULE_SQL = _ON_SCHEDULE
