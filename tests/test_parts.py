"""Runs are dealt to parts by their rows, so that a task's share does not grow with the table."""

from pyspark.sql import functions as F

from trailcast.plans import features as PF
from trailcast.sources import standin as S


def test_parts_grow_with_the_events_and_change_nothing(spark, sf_dir, monkeypatch):
    plain = sorted(map(tuple, PF.prefix_features_base(spark, sf_dir).collect()), key=repr)
    monkeypatch.setattr(S, "PART_ROWS", 50, raising=False)
    log = S.event_log(spark, sf_dir)
    sizes = log.groupBy(F.spark_partition_id().alias("part"), "trajectory_id").count().collect()
    assert log.rdd.getNumPartitions() == log.count() // 50
    assert len({r["trajectory_id"] for r in sizes}) == len(sizes)  # whole runs
    assert sorted(map(tuple, PF.prefix_features_base(spark, sf_dir).collect()), key=repr) == plain
