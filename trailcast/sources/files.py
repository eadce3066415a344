"""Run logs and result tables in files: readers by kind and suffix, writers, resumable appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Raw run logs as text; a nested trajectory is kept as JSON text.
RAW_SCHEMA = ("instance_id string, model_name string, target string, trajectory string, exit_status string, "
              "generated_patch string, eval_logs string")
#: Raw rows of the tool-call dialect: two JSON texts and a reward.
TOOL_SCHEMA = "ds string, messages string, reward double"

_SUFFIXES = {"jsonl": "json", "json": "json", "csv": "csv", "parquet": "parquet"}
_COMPRESSION = ("gz", "bz2", "zst", "snappy", "lz4")


def file_format(path: str) -> str:
    """Format by suffix, with a compression suffix allowed after it; a path without one is a Parquet folder."""
    parts = path.rstrip("/").rsplit("/", 1)[-1].lower().split(".")
    if len(parts) > 2 and parts[-1] in _COMPRESSION:
        parts.pop()
    if len(parts) == 1:
        return "parquet"
    try:
        return _SUFFIXES[parts[-1]]
    except KeyError:
        raise ValueError(f"no reader for {path}: known suffixes are {', '.join(sorted(_SUFFIXES))}") from None


def read_json_lines(spark: SparkSession, path: str, schema: str = RAW_SCHEMA, bad: str | None = None) -> DataFrame:
    """One row per line. Blank lines are skipped.

    A line that cannot be read stops the job; with ``bad`` it becomes a row of nulls that holds the line in
    the column of that name.
    """
    if bad is None:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{schema}, `{bad}` string").option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", bad).json(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, multiline: bool = False) -> DataFrame:
    """CSV with a header line; without a schema all columns are text.

    A large file is read in parts by many tasks. If quoted fields hold line breaks, say ``multiline``:
    a file is then read by one task, and only several files are read side by side.
    """
    reader = spark.read.option("header", "true").option("escape", '"').option("multiLine", multiline)
    return (reader if schema is None else reader.schema(schema)).csv(path)


def read_table(spark: SparkSession, path: str, schema: str | None = None, multiline: bool = False) -> DataFrame:
    """A table in the format its suffix names. JSON lines need a schema; Parquet has its own."""
    kind = file_format(path)
    if kind == "json":
        return read_json_lines(spark, path, RAW_SCHEMA if schema is None else schema)
    if kind == "csv":
        return read_csv(spark, path, schema, multiline)
    return spark.read.parquet(path)


def read_runs(spark: SparkSession, kind: str, known: dict[str, str] | None = None, first: int | None = None) -> DataFrame:
    """Raw runs of a named source (``known`` maps names to paths) or of a path; ``first`` keeps a sample of n rows."""
    df = read_table(spark, (known or {}).get(kind, kind))
    return df if first is None else df.limit(first)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Write in the format the suffix names, from all tasks at once; every path is a folder of part files."""
    kind = file_format(path)
    writer = df.write.mode(mode).partitionBy(*(partition_by or []))
    if kind == "csv":
        writer = writer.option("header", "true").option("escape", '"').option(
            "ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
    if kind == "json":
        writer = writer.option("ignoreNullFields", "false")
    writer.format(kind).save(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Add rows to a table, which need not exist yet."""
    write_table(df, path, mode="append")


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path, in any store that Spark can reach."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def remaining(todo: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Rows of ``todo`` whose key is not yet in the table of results at ``path``."""
    if not is_written(todo.sparkSession, path):
        return todo
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in todo.select(*keys).schema)
    return todo.join(read_table(todo.sparkSession, path, schema).select(*keys), keys, "left_anti")


def score_remaining(todo: DataFrame, path: str, keys: list[str], score) -> DataFrame:
    """Score what has no result yet, append it, and return all results.

    ``score`` takes and returns a DataFrame. A run that was stopped goes on where the last append ended;
    appends are committed as a whole. Null keys never count as done. Results are kept as Parquet.
    """
    if file_format(path) != "parquet":
        raise ValueError("resumable results are kept as Parquet")
    append_rows(score(remaining(todo, path, keys)), path)
    return todo.sparkSession.read.parquet(path)


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join of two score tables that must pair up: a row without a partner, or with two, stops the job.

    Repeats are found by counts per key, so a key with many repeats is never multiplied.
    """
    def once(df: DataFrame, n: str) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n), *[F.first(c).alias(c) for c in rest])

    paired = once(left, "_n_left").join(once(right, "_n_right"), keys, "full")
    ok = F.coalesce((F.col("_n_left") == 1) & (F.col("_n_right") == 1), F.lit(False))
    message = F.concat(F.lit("not one to one: "), F.to_json(F.struct(*keys)))
    # The check is part of a kept column, so that no plan can leave it out.
    checked = F.when(ok, F.col(keys[0])).otherwise(F.raise_error(message))
    return paired.withColumn(keys[0], checked).drop("_n_left", "_n_right")
