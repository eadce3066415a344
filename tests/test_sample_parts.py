"""Samples lie in parts by rows, however many there are."""

from trailcast.sources import standin as S


def test_samples_in_parts_by_rows_are_the_same(spark, sf_dir, monkeypatch):
    want = S.samples(spark, sf_dir)
    want = sorted(map(tuple, want.collect()))
    monkeypatch.setattr(S, "PART_SAMPLES", 200)
    parts = S.samples(spark, sf_dir)
    n = len(want)
    sizes = parts.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == -(-n // 200) and max(sizes) < 400
    assert sorted(map(tuple, parts.collect())) == want
