"""Alert policy over a stream of scored steps, and running streams to their end."""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trailcast.session import shared_folder

OUTPUT = ("trajectory_id string, prefix_step bigint, risk double, abstain bigint, would_alarm bigint, "
          "alarm bigint, n_alarms bigint")


def mark(seen: list[int], step: int) -> bool:
    """Add a step to ascending ranges (first, last, first, last, ...); False if it is in one already."""
    at = bisect_right(seen, step)
    if at % 2 or (at and seen[at - 1] == step):
        return False
    joins_left, joins_right = at > 0 and seen[at - 1] == step - 1, at < len(seen) and seen[at] == step + 1
    seen[at - joins_left:at + joins_right] = [] if joins_left and joins_right else [step] if joins_left or joins_right else [step, step]
    return True


class AlertPolicy(StatefulProcessor):
    """Step floor, confidence floor, cooldown and budget; remembers judged steps and alarms.

    Steps are judged in the order they come; within a batch they are sorted. Judged step numbers are
    kept as ranges: a step inside one is a repeat and is dropped, a late step in a gap gets its verdict
    from the alarms so far. The cooldown holds to both sides of every alarm. A step with ``act`` 0 has no
    intervention to call for: it may be found worth an alarm, but raises none and uses nothing up.
    """

    def __init__(self, threshold: float, min_step: int = 5, conf_floor: float = 0.0, cooldown: int = 5,
                 budget: int = 2, shadow: bool = False, ttl_ms: int | None = None):
        self.threshold, self.min_step, self.conf_floor = threshold, min_step, conf_floor
        self.cooldown, self.budget, self.shadow, self.ttl_ms = cooldown, budget, shadow, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("policy", "seen array<bigint>, alarms array<bigint>", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seen, alarms = map(list, self.state.get() or ([], []))
        # seen: first and last step of each judged range, ascending
        out = []
        for r in sorted(rows, key=lambda x: x.prefix_step):
            step = r.prefix_step
            if not mark(seen, step):
                continue
            committed = step >= self.min_step and abs(r.risk - 0.5) >= self.conf_floor
            rested = all(abs(step - a) >= self.cooldown for a in alarms)
            would = committed and r.risk >= self.threshold and rested and len(alarms) < self.budget
            if would and r.act:
                alarms.append(step)
            out.append(Row(trajectory_id=key[0], prefix_step=step, risk=r.risk, abstain=int(not committed),
                           would_alarm=int(would), alarm=int(bool(would and r.act and not self.shadow)), n_alarms=len(alarms)))
        self.state.update((seen, alarms))
        return iter(out)

    def close(self) -> None:
        pass


def verdict_stream(scored: DataFrame, policy: AlertPolicy) -> DataFrame:
    """Verdict of every scored step (trajectory_id, prefix_step, risk and, if there, act)."""
    act = F.col("act").cast("bigint") if "act" in scored.columns else F.lit(1).cast("bigint")
    return scored.select("trajectory_id", "prefix_step", F.col("risk").cast("double").alias("risk"), act.alias("act")).groupBy(
        "trajectory_id").transformWithState(
        statefulProcessor=policy, outputStructType=OUTPUT, outputMode="Append",
        timeMode="None" if policy.ttl_ms is None else "ProcessingTime")


def open_steps(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def keyed_state(spark: SparkSession) -> None:
    """Name the state store that keyed state needs; a session's default one cannot hold it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_to_end(stream: DataFrame, folder: str) -> DataFrame:
    """Process everything that is there, append it to a table and return the table.

    ``folder`` holds table and progress, so a restarted run goes on where it stopped.
    """
    spark = stream.sparkSession
    keyed_state(spark)
    q = (stream.writeStream.format("parquet").outputMode("append")
         .option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/progress")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


def staged(df: DataFrame, n_files: int | None = None) -> tuple[str, str]:
    """Write a table for a stream to read; returns its folder and schema."""
    folder = f"{shared_folder(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    rows = df if n_files is None else df.repartition(n_files)
    rows.write.parquet(f"{folder}/input")
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return folder, schema


def captured_runs(verdicts: DataFrame, part: int = 1000) -> DataFrame:
    """Risk arrays per run for later replay, at most ``part`` steps to an array."""
    return verdicts.groupBy("trajectory_id", F.floor(F.col("prefix_step") / part).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("prefix_step").alias("step"), "risk"))).alias("risks"))
