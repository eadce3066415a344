import hashlib
from collections import defaultdict

import pytest

from trailcast.llm import digest_merge

CLASHING = "doc_id long, text string, row long, node long, key string, n long, up long"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, keep):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[lowered(text)].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        kept = [False] * len(ids)
        kept[ids.index(best)] = True
        out += [(i, best, len(ids), k, digest) for i, k in zip(ids, kept)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("settings", [{}, {"fan": 2, "key_bits": 2, "leaf_rows": 3}])
def test_groups_equal_brute_force(spark, edge_docs, keep, settings):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    rows += [(100 + i, ("Copy Of A Text" if i % 2 else "copy of a text") if i % 3 else f"own {i % 8} É") for i in range(60)]
    rows += [(None, None), (None, "ownerless"), (None, "OWNERLESS"), (7, "x" * 300_000), (8, "X" * 300_000), (110, "Copy of a text")]
    docs = spark.createDataFrame([(i, t, 1, 2, "k", 3, 4) for i, t in rows], CLASHING).repartition(7)
    got = sorted(map(tuple, digest_merge.groups(docs, keep, **settings).collect()), key=repr)
    assert got == brute(rows, keep)


def test_empty_table_and_one_row(spark):
    docs = spark.createDataFrame([(3, None)], "doc_id long, text string")
    assert digest_merge.groups(docs.where("false")).count() == 0
    assert [tuple(r) for r in digest_merge.groups(docs).collect()] == [(3, 3, 1, True, hashlib.sha256(b"").hexdigest())]
