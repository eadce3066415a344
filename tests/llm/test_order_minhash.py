"""Candidates of the near-duplicate operator against brute force."""

import random

from trailcast.llm import order_minhash


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_force(texts):
    """The smallest text number of each text's class."""
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            n = max(len(a), len(b))
            if len(set(a) & set(b)) >= 0.4 * n and distance(a, b) <= 0.2 * n:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def found(spark, texts):
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in order_minhash.classes(docs).collect()}
    return [got[i] for i in range(len(texts))]


def test_pairs_over_one_shared_passage_meet(spark, monkeypatch):
    """All that near copies have in common in k-mers is a passage that strangers have too."""
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(80)]
    own = lambda: [f"o{rng.randint(0, 99999)}" for _ in range(24)]
    texts = [passage + own() for _ in range(16)]
    for _ in range(8):
        first = own()
        texts.append(passage + first)
        texts.append(passage + [w if k % 2 else f"e{rng.randint(0, 99999)}" for k, w in enumerate(first)])
    want = brute_force(texts)
    assert len(set(want)) == 24
    assert found(spark, texts) == want
    monkeypatch.setattr(order_minhash, "TILE", 3)  # several tiles a bucket
    assert found(spark, texts) == want
    monkeypatch.setattr(order_minhash, "LARGE", 2)  # by rare word pairs
    assert found(spark, texts) == want


def test_scattered_edits_near_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.85 with single words replaced at random places, short texts too."""
    rng = random.Random(9)
    texts = []
    for k in range(120):
        n = (10, 20, 33, 60, 100, 150)[k % 6]
        words = [f"w{rng.randint(0, 99999)}" for _ in range(n)]
        edits = rng.sample(range(n), int(n * (0.2, 0.18, 0.15)[k % 3]))
        texts += [words, [f"e{rng.randint(0, 99999)}" if i in edits else w for i, w in enumerate(words)]]
    want = brute_force(texts)
    assert len(set(want)) == 120
    assert found(spark, texts) == want


def test_large_groups_make_few_pairs(spark, monkeypatch):
    """Near copies of one text, in pieces at first, and strangers over one passage: what is written stays linear."""
    rng = random.Random(10)
    passage = [f"p{k}" for k in range(60)]
    own = lambda n: [f"o{rng.randint(0, 10**6)}" for _ in range(n)]
    base = own(50)
    texts = [passage + own(70) for _ in range(700)]
    texts += [passage + [w if rng.random() > 0.06 else f"e{rng.randint(0, 10**6)}" for w in base] for _ in range(700)]
    sizes = []
    meetings = order_minhash._meetings
    monkeypatch.setattr(order_minhash, "_meetings", lambda *a, **k: sizes.append((t := meetings(*a, **k)).count()) or t)
    got = found(spark, texts)
    assert got == [*range(700), *[700] * 700]
    assert sum(sizes) < 3 * len(texts)


def test_word_pairs_and_whole_texts_are_not_joined(spark, monkeypatch):
    """Counts of word pairs come from a table of counters, and texts are thinned by a bitmap before they are joined."""
    rng = random.Random(11)
    passage = [f"p{k}" for k in range(60)]
    own = lambda n: [f"o{rng.randint(0, 10**6)}" for _ in range(n)]
    texts = [passage + own(70) for _ in range(100)] + [own(80) for _ in range(400)]
    texts += [[w if k % 11 else f"e{k}" for k, w in enumerate(t)] for t in texts[:40]]
    plans, write = [], order_minhash.common.write_table
    monkeypatch.setattr(order_minhash.common, "write_table", lambda df, *a: plans.append(
        df._jdf.queryExecution().optimizedPlan().toString()) or write(df, *a))
    monkeypatch.setattr(order_minhash, "MOST_COUNTERS", 8)  # most pairs share a counter
    got = found(spark, texts)
    assert got == [*range(500), *range(40)]
    lines = [line for plan in plans for line in plan.splitlines() if "Join" in line]
    assert lines and not any("gram" in line for line in lines)
    assert any("LeftSemi" in line and "shiftright" in line for line in lines)


def test_entries_meet_in_parts(spark, monkeypatch):
    """Many entries with bags meet in parts, and no pair is lost by that."""
    rng = random.Random(12)
    passage = [f"p{k}" for k in range(40)]
    own = lambda: [f"o{rng.randint(0, 99999)}" for _ in range(12)]
    texts = [passage + own() for _ in range(12)]
    for _ in range(8):
        first = own()
        texts.append(passage + first)
        texts.append(passage + [w if k % 2 else f"e{rng.randint(0, 99999)}" for k, w in enumerate(first)])
    monkeypatch.setattr(order_minhash, "MEETING_BYTES", 1)
    unions, write = [], order_minhash.common.write_table
    monkeypatch.setattr(order_minhash.common, "write_table", lambda df, *a: unions.append(
        df._jdf.queryExecution().analyzed().toString().count("Relation [a#")) or write(df, *a))
    assert found(spark, texts) == brute_force(texts)
    assert max(unions) == order_minhash.PASSES
