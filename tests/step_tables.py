"""Small step tables for tests."""


def make_steps(spark, runs):
    """Steps from {run: [(action, observation), ...]}."""
    rows = [(run, f"org__repo-{i}", "m", k, "", action, observation)
            for i, (run, steps) in enumerate(runs.items()) for k, (action, observation) in enumerate(steps)]
    return spark.createDataFrame(
        rows, "trajectory_id string, instance_id string, model_name string, step_index bigint, "
              "thought_text string, action_text string, observation_text string")
