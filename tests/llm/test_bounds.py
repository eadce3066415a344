"""Inputs beyond the sizes that one block, index or plan takes."""

import random

import numpy as np
from pyspark.sql import functions as F

from trailcast.llm import pstable, url_filter


def brute_rules(host, path, rules):
    fitting = [(len(r), -k, v, r) for k, (v, r) in enumerate(rules)
               if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0]))
               and path.startswith(r[len(r.partition("/")[0]):])]
    return max(fitting)[2:][::-1] if fitting else None


def test_five_thousand_rules(spark):
    rng = random.Random(3)
    names = ["a", "b", "c.a", "net", "org", "x.net", "deep.c.a", "example.org"]
    rules = [("block" if k % 2 else "allow", f"{rng.choice(names)}/{rng.choice(['', 'p', 'p/q', f'p{k % 900}/', f'{k}'])}") for k in range(5000)]
    hosts = ["a", "b.a", "deep.c.a", "w.deep.c.a", "net", "www.x.net", "xnet", "", "other", "example.org", "..a", "a."]
    rows = [(h, p) for h in hosts for p in ["", "/", "/p", "/p/q/r", "/p17/x", "/4321", "/zzz"]] * 2
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, host string, path string").repartition(3)
    got = url_filter.joined_rules(df, url_filter.rule_table(spark, rules)).orderBy("id").collect()
    assert [(r["_rule"]["rule"], r["_rule"]["verdict"]) if r["_rule"] else None for r in got] == [brute_rules(h, p, rules) for h, p in rows]
    pages = spark.createDataFrame([(7, "http://w.deep.c.a/p/q", "mine"), (7, "http://w.deep.c.a/p/q", "mine"), (8, None, "mine")],
                                  "page_id long, url string, host string")
    for table in (pages, pages.where("false")):
        few = url_filter.judge(table, rules[:90], None).collect()
        joined = url_filter.judge(table, url_filter.rule_table(spark, rules[:90]), None).collect()
        assert sorted(map(str, few)) == sorted(map(str, joined)) and len(few) == table.count()
    assert url_filter.judge(pages, rules, None).count() == 3


def test_searches_in_twelve_hundred_dimensions(spark):
    rng = np.random.default_rng(5)
    rows = [(3 * d + i, rng.normal(size=d).tolist()) for d in range(1, 1201) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    got = {}
    for r in pstable.search(df, df.where("vec_id % 20 = 0"), k=2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    by_d = {}
    for i, v in rows:
        by_d.setdefault(len(v), []).append((i, np.array(v)))
    want = {}
    for own in by_d.values():
        for i, v in own:
            if i % 20 == 0:
                order = sorted((-float(v @ w), j) for j, w in own if j != i)
                want[i] = [(k, j) for k, (_, j) in enumerate(order[:2], 1)]
    assert {q: sorted(x) for q, x in got.items()} == want


def test_an_index_next_to_small_dimensions(spark, monkeypatch):
    monkeypatch.setattr(pstable, "TILE", 40)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)] + [(1000 + i, rng.normal(size=2).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = pstable.search(df, df.where(F.col("vec_id") % 20 == 0), k=3)
    per = {r["query_id"]: r["n"] for r in out.groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    assert per == {i: 3 for i, _ in rows if i % 20 == 0}


def test_small_tables_are_searched_by_the_index(spark, monkeypatch):
    """Rows are hashed and buckets are probed however few rows there are."""
    monkeypatch.setattr(pstable, "_visits", lambda options, coverage: lambda batches: iter(()))
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(200)], "vec_id long, embedding array<double>")
    assert pstable.search(df, df.where("vec_id % 20 = 0"), k=3).count() == 0  # no visit, no neighbour


def test_queries_beyond_a_block_meet_all_rows(spark, monkeypatch):
    monkeypatch.setattr(pstable, "TILE", 40)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(150, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in pstable.search(df, df, k=4, coverage=2.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for i, v in enumerate(x):
        order = sorted((-float((v * w).sum()), j) for j, w in enumerate(x) if j != i)[:4]
        assert sorted(got[i]) == [(k, j) for k, (_, j) in enumerate(order, 1)]


def test_repeated_rows_take_no_place_of_others(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x) for _ in range(1 + i % 3)], "vec_id long, embedding array<double>")
    got = {}
    for r in pstable.search(df, df.where("vec_id % 10 = 0"), k=12, coverage=2.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for i in range(0, 60, 10):
        order = sorted((-float((x[i] * w).sum()), j) for j, w in enumerate(x) if j != i)[:12]
        assert sorted(got[i]) == [(k, j) for k, (_, j) in enumerate(order, 1)]
