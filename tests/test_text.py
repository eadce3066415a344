"""Parser and text cases with known answers."""

import pytest
from pyspark.sql import functions as F

from trailcast.functions import text as T


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "s string").select(make(F.col("s")).alias("x")).first().x


@pytest.mark.parametrize("action,kind", [
    ("python -m pytest tests/", "test"), ("cat foo.py", "read"), ("rg foo", "search"), ("sed -i s/a/b/ x.py", "edit"),
    ("sed -n 1,5p x.py", "read"), ("python tokens.py", "other"), ("python reproduce.py", "test"), ("pip install x", "install"),
    ("git diff", "git"), ("submit", "submit"), ("cd src", "environment"), ("", "unknown"), ("echo hi > out.txt", "edit")])
def test_action_type(spark, action, kind):
    assert one(spark, action, T.action_type) == kind


@pytest.mark.parametrize("text,expected", [
    ("1 failed, 4 passed", (4, 1)), ("5 passed", (5, 0)), ("FAILED tests/x", (None, 1)), ("nothing", (None, None)),
    ("2 errors, 1 failed", (0, 3)), ("PASSED a\nPASSED b", (2, 0))])
def test_counts(spark, text, expected):
    row = one(spark, text, lambda c: F.struct(*[x.alias(n) for x, n in zip(T.test_counts(c), "pf")]))
    assert (row.p, row.f) == expected


def test_file_paths_keep_order_and_extension_order(spark):
    assert one(spark, "cat b/x.py a.json b/x.py setup.cfg", T.file_paths) == ["b/x.py", "a.js", "setup.c"]
    assert one(spark, "a.json setup.cfg", lambda c: T.file_paths(c, True)) == ["a.json", "setup.cfg"]


@pytest.mark.parametrize("message,thought,action", [
    ("look\n```bash\nls\n```", "look", "ls"), ("THOUGHT: why ACTION: ls -la", "why", "ls -la"), ("just text", "just text", "just text"),
    ("so ACTION: go", "so", "go"), ("", "", ""), ("a\n```\none\n```\nb\n```sh\ntwo\n```", "a\n\nb", "two")])
def test_split_message(spark, message, thought, action):
    row = one(spark, message, lambda c: F.struct(*[x.alias(n) for x, n in zip(T.split_message(c), "ta")]))
    assert (row.t, row.a) == (thought, action)


def test_small_helpers(spark):
    assert one(spark, "# note\n\n `ls -la` \npwd", T.first_command) == "ls -la"
    assert one(spark, "scikit-learn__scikit-learn-999", T.repository) == "scikit-learn__scikit-learn"
    assert one(spark, "  a b \n", T.one_line) == "a b"
    assert one(spark, "tests/test_a.py", T.is_test_path) and not one(spark, "src/a.py", T.is_test_path)
    assert one(spark, "src/a.py", T.directory) == "src" and one(spark, "a.py", T.directory) == ""
    assert one(spark, "", T.repository) == "unknown"
