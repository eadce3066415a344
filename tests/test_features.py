"""Features: brute force over prefixes, causality, block scan and streams."""

import itertools
import re

import pytest
from step_tables import make_steps
from pyspark.sql import functions as F

from trailcast.operators import features as FT
from trailcast.operators import prefixes as PX
from trailcast.operators.scan import (
    RunScan, following, last_before, last_seen, previous, recent_list, recent_sum, running_max, running_sum)
from trailcast.sources import standin as S

ACTIONS = ["cat a.py", "sed -i s/x/y/ a.py", "python -m pytest tests/test_a.py", "rg foo", "", "cat lib/b.py",
           "sed -i s/x/y/ lib/c.py", "ls", "sed -i s/x/y/ a.py", "pip install q"]
OBSERVATIONS = ["line 1", "", "2 failed, 1 passed", "Traceback (most recent call last)\nKeyError: x", "command not found", "1 failed, 3 passed"]


def example(spark, n=60):
    picks = {f"r{i}": [(ACTIONS[(j * (i + 3) + j * j) % len(ACTIONS)], OBSERVATIONS[(j * (i + 1) + j // 3) % len(OBSERVATIONS)])
                       for j in range(n - 7 * i)] for i in range(3)}
    return make_steps(spark, picks)


def labels(steps):
    return steps.groupBy("trajectory_id").agg(F.count(F.lit(1)).alias("n_total_steps")).withColumn("y_fail", F.lit(1).cast("bigint"))


def collect(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_block_scan_equals_whole_runs(spark):
    rows = spark.range(0, 300).select(
        (F.col("id") % 3).cast("string").alias("trajectory_id"), F.floor(F.col("id") / 3).alias("step_index"),
        F.when(F.col("id") % 7 < 4, F.col("id") * 37 % 101).alias("v"))
    v = F.col("v")
    ops = dict(s=running_sum(v), m=running_max(v), l=last_seen(v), b=last_before(v), p=previous(v, 2), f=following(v),
               r=recent_sum(v, 5), c=recent_list(v, 4))
    whole, blocks = RunScan(), RunScan(block_rows=8)
    assert collect(whole.apply(rows, **ops)) == collect(blocks.apply(rows, **ops))
    keyed = dict(n=(F.col("v") > 10, [F.col("v") % 5]))
    assert collect(whole.occurrences(rows, **keyed)) == collect(blocks.occurrences(rows, **keyed))


def test_long_runs_take_the_block_path_with_equal_results(spark):
    steps = example(spark)
    expected = FT.prefix_table(steps, labels(steps), features="dynamics", text=True, similarity="edit")
    actual = FT.prefix_table(steps, labels(steps), features="dynamics", text=True, similarity="edit", hot_rows=50, block_rows=16)
    assert expected.columns == actual.columns
    assert collect(expected) == collect(actual)


def test_no_look_ahead(spark):
    steps = example(spark)
    full = FT.prefix_table(steps, labels(steps), features="dynamics", similarity="edit")
    cut = steps.where("step_index < 20")
    part = FT.prefix_table(cut, labels(cut), features="dynamics", similarity="edit")
    key = ["trajectory_id", "prefix_step"]
    features = PX.feature_columns(full)
    assert collect(part.select(*key, *features)) == collect(full.where("prefix_step <= 20").select(*key, *features))


def test_half_of_compression_and_similarity_against_python(spark):
    import zlib
    from difflib import SequenceMatcher

    steps = example(spark)
    cmds = {}
    for r in steps.orderBy("trajectory_id", "step_index").collect():
        cmds.setdefault(r.trajectory_id, []).append(r.action_text)
    for r in FT.prefix_table(steps, labels(steps), features="dynamics").collect():
        seen = cmds[r.trajectory_id][:r.prefix_step]
        raw = "\n".join(seen).encode()
        assert r["f__adv_seq_compress"] == pytest.approx(len(zlib.compress(raw, 6)) / len(raw) if raw else 1.0)
        pairs = [(a, b) for a, b in itertools.pairwise(seen)][-8:]
        sims = [SequenceMatcher(None, a, b).ratio() for a, b in pairs if a or b]
        assert r["f__adv_seq_consec_cmd_sim"] == pytest.approx(sum(sims) / len(sims) if sims else 0.0)


def test_schedule(spark):
    def steps_of(n, mode):
        rows = spark.range(1, n + 1).withColumn("n", F.lit(n))
        return [r.id for r in rows.where(PX.on_schedule(F.col("id"), F.col("n"), mode)).orderBy("id").collect()]

    assert steps_of(0, "default") == [] and steps_of(3, "default") == [1, 2, 3]
    assert steps_of(22, "default") == [1, 2, 3, 4, 5, 10, 15, 20, 22]
    assert steps_of(25, "sparse") == [1, 3, 5, 10, 20, 25]
    assert steps_of(67, "dense") == [*range(1, 61), 65, 67]


def test_outcome_names_are_refused():
    PX.check_no_outcome_columns(["f__n_edit"])
    with pytest.raises(ValueError):
        PX.check_no_outcome_columns(["f__target_file_count"])


def test_gate_passes_for_a_sound_table(spark):
    steps = example(spark)
    assert PX.check_prefixes(FT.prefix_table(steps, labels(steps))).count() > 0


def test_hour_numbering_equals_window(spark, sf_dir):
    a = S.event_log(spark, sf_dir).select("event_id", "step_index")
    b = S.event_log(spark, sf_dir, hot_rows=10).select("event_id", "step_index")
    assert collect(a) == collect(b)


def test_stream_handles_order_repeats_and_restart(spark, tmp_path):
    from trailcast.streaming import alert_policy as AP
    from trailcast.streaming import step_features as SF

    steps = example(spark, 30)
    schema = ", ".join(f"{n} {t}" for n, t in steps.dtypes)
    late, first = steps.where("step_index % 3 = 1"), steps.where("step_index % 3 <> 1")
    source = str(tmp_path / "in")
    first.union(first).coalesce(1).write.mode("append").parquet(source)
    AP.run_to_end(SF.feature_stream(AP.open_steps(spark, source, schema)), str(tmp_path / "out"))
    late.coalesce(1).write.mode("append").parquet(source)
    out = AP.run_to_end(SF.feature_stream(AP.open_steps(spark, source, schema)), str(tmp_path / "out"))
    batch = FT.prefix_table(steps, labels(steps), schedule="dense")
    names = [n for n in FT.BASE_FEATURES if n != "prefix_step"]
    assert collect(out.select("trajectory_id", "prefix_step", *names)) == collect(
        batch.select("trajectory_id", "prefix_step", *[f"f__{n}" for n in names]))


def test_one_compressor_serves_all_cuts():
    import random
    import zlib

    rng = random.Random(2)
    for n in (0, 1, 300, 5_000, 90_000):
        raw = bytes(rng.choice(b"ab\ncat sed pytest") for _ in range(n))
        cuts = sorted({0, n, *(rng.randint(0, n) for _ in range(40))})
        want = [len(zlib.compress(raw[:c], 6)) / c if c else 1.0 for c in cuts]
        assert FT.leading_ratios(raw, cuts) == want


def test_wide_rows_are_not_shuffled_again(spark, sf_dir):
    """A Python function on wide rows would lose their partitioning by run, and each later window would shuffle them."""
    from trailcast.plans import features as PF

    plan = PF.prefix_features_full(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert dealt and not [keys for keys in dealt if "_k_" in keys or "_groupingexpression" in keys]
