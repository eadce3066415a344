"""Alert policy over several micro-batches."""

import random
import time

from trailcast.streaming import alert_policy as AP


def test_ranges_of_judged_steps():
    rng = random.Random(3)
    seen, known = [], set()
    for _ in range(300):
        step = rng.randint(0, 60)
        assert AP.mark(seen, step) == (step not in known)
        known.add(step)
    assert seen == sorted(seen)
    assert {x for a, b in zip(seen[::2], seen[1::2]) for x in range(a, b + 1)} == known


def test_late_steps_are_judged_and_repeats_dropped(spark, tmp_path):
    schema = "trajectory_id string, prefix_step bigint, risk double"
    for k, steps in enumerate([(6, 20), (7, 20), (6, 5, 12), (12, 21)]):
        spark.createDataFrame([("a", s, 0.9) for s in steps], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/input")
        time.sleep(1.1)  # files are read by age
    scored = AP.open_steps(spark, f"{tmp_path}/input", schema, files_per_batch=1)
    rows = AP.run_to_end(AP.verdict_stream(scored, AP.AlertPolicy(0.6, budget=3)), str(tmp_path)).collect()
    got = {r.prefix_step: r.alarm for r in rows}
    assert len(rows) == len(got)
    assert got == {5: 0, 6: 1, 7: 0, 12: 1, 20: 1, 21: 0}
