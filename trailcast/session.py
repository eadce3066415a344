"""Session settings the jobs rely on, and the one way lineage is cut."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Text classification costs much CPU per byte: keep small partitions apart.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # Bytes are counted compressed; rows with all features take many times as much in a task.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.session.timeZone": "UTC",
    # Lets a join on (run, step) use an existing partitioning by run.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to a session someone else created."""
    for key, value in _SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("trailcast")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    for key, value in _SQL_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names, which all executors share.

    Only a session without a cluster may leave the setting out; it gets a folder under
    ``/tmp/checkpoints``.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = f"/tmp/checkpoints/trailcast-{uuid.uuid4().hex}"
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint on shared storage, so the data survives a lost executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_held: list[DataFrame] = []


def reuse(df: DataFrame) -> DataFrame:
    """Keep a table that one job reads several times. Lost blocks are recomputed from its lineage."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    _held.append(kept)
    return kept


def release() -> None:
    """Drop what earlier jobs kept."""
    while _held:
        _held.pop().unpersist()
