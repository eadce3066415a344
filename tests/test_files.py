"""Readers, writers and resumable scoring on small files."""

import json

import pytest
from pyspark.sql import functions as F

from trailcast.operators import normalize as N
from trailcast.sources import files as FS

RUN = {"instance_id": "a__b-1", "model_name": "m", "target": True,
       "trajectory": [{"role": "assistant", "content": "look\n```\nls\n```"}, {"role": "user", "content": "x.py"}]}


def test_json_lines_skip_blanks_and_keep_nested_logs_as_text(spark, tmp_path):
    path = tmp_path / "runs.jsonl"
    path.write_text("\n" + json.dumps(RUN) + "\n\n   \n" + json.dumps({"instance_id": "c", "target": 0}) + "\n")
    rows = {r.instance_id: r for r in FS.read_runs(spark, str(path)).collect()}
    assert set(rows) == {"a__b-1", "c"}
    assert json.loads(rows["a__b-1"].trajectory) == RUN["trajectory"] and rows["a__b-1"].target == "true"
    assert rows["c"].trajectory is None
    runs, steps = N.normalize(FS.read_runs(spark, str(path)))
    assert {(r.instance_id, r.y_fail) for r in runs.collect()} == {("a__b-1", 0), ("c", 1)}
    assert [r.observation_text for r in steps.collect()] == ["x.py"]


def test_bad_lines_stop_or_are_kept(spark, tmp_path):
    path = tmp_path / "runs.jsonl"
    path.write_text('{"instance_id": "a"}\n{"instance_id": \n')
    with pytest.raises(Exception):
        FS.read_json_lines(spark, str(path)).collect()
    rows = FS.read_json_lines(spark, str(path), bad="line").collect()
    assert sorted((r.instance_id or "", r.line or "") for r in rows) == [("", '{"instance_id": '), ("a", "")]


@pytest.mark.parametrize("name, kind", [
    ("a.jsonl", "json"), ("a.json.gz", "json"), ("A.CSV", "csv"), ("a.parquet", "parquet"), ("folder/", "parquet")])
def test_format_by_suffix(name, kind):
    assert FS.file_format(f"/x.y/{name}") == kind


def test_unknown_suffix_is_named():
    with pytest.raises(ValueError, match="a.xlsx"):
        FS.file_format("a.xlsx")


@pytest.mark.parametrize("suffix", ["jsonl", "csv", "parquet"])
def test_written_tables_read_back(spark, tmp_path, suffix):
    schema = "id bigint, body string, score double"
    rows = [(1, 'a "quoted", text\nwith a break', 0.5), (2, None, None), (3, "ü", -1.25)]
    path = str(tmp_path / f"t.{suffix}")
    FS.write_table(spark.createDataFrame(rows, schema), path)
    back = FS.read_table(spark, path, schema, multiline=True)
    assert sorted(map(tuple, back.collect())) == rows
    FS.append_rows(spark.createDataFrame([(4, "b", 0.0)], schema), path)
    assert FS.read_table(spark, path, schema, multiline=True).count() == 4


def test_partitions_and_first_rows(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    FS.write_table(spark.range(10).withColumn("fold", F.col("id") % 2), path, ["fold"])
    assert sorted(p.name for p in (tmp_path / "t.parquet").glob("fold=*")) == ["fold=0", "fold=1"]
    assert FS.read_runs(spark, "full", {"full": path}, first=3).count() == 3


def test_scoring_goes_on_where_it_stopped(spark, tmp_path):
    path = str(tmp_path / "scores.parquet")
    seen = []

    def score(df):
        seen.append(sorted(r.id for r in df.collect()))
        return df.withColumn("risk", F.col("id") / 10)

    assert FS.score_remaining(spark.range(3), path, ["id"], score).count() == 3
    assert FS.score_remaining(spark.range(5), path, ["id"], score).count() == 5
    assert FS.score_remaining(spark.range(5), path, ["id"], score).count() == 5
    assert seen == [[0, 1, 2], [3, 4], []]


def test_one_to_one(spark):
    a = spark.createDataFrame([("p", 0.1), ("q", 0.2)], "prefix_id string, a double")
    b = spark.createDataFrame([("q", 0.4), ("p", 0.3)], "prefix_id string, b double")
    assert sorted(map(tuple, FS.one_to_one(a, b, ["prefix_id"]).collect())) == [("p", 0.1, 0.3), ("q", 0.2, 0.4)]
    for wrong in (b.limit(1), b.union(b.limit(1))):
        with pytest.raises(Exception, match="not one to one"):
            FS.one_to_one(a, wrong, ["prefix_id"]).collect()


def test_csv_is_split_unless_fields_hold_line_breaks(spark, tmp_path):
    plain = str(tmp_path / "plain.csv")
    spark.range(40_000).select("id", F.lit("some text, quoted").alias("t")).coalesce(1).write.option("header", "true").csv(plain)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    try:
        split, whole = FS.read_csv(spark, plain, "id bigint, t string"), FS.read_csv(spark, plain, "id bigint, t string", multiline=True)
        assert split.rdd.getNumPartitions() > 4 and whole.rdd.getNumPartitions() == 1
        assert split.agg(F.sum("id")).first() == whole.agg(F.sum("id")).first() and split.count() == 40_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    broken = str(tmp_path / "broken.csv")
    FS.write_table(spark.createDataFrame([(1, 'a "b"\n c'), (2, "d")], "id bigint, t string"), broken)
    got = FS.read_table(spark, broken, "id bigint, t string", multiline=True).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 'a "b"\n c'), (2, "d")]
