import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from trailcast.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """Root, and for each leaf its siblings as (left, right) level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            start = p // 16 * 16
            paths[i].append(("".join(nodes[start:p]), "".join(nodes[p + 1:start + 16])))
        nodes = [sha("".join(nodes[i:i + 16])) for i in range(0, len(nodes), 16)]
        at = [p // 16 for p in at]
    return nodes[0], paths


def brute(rows):
    sources = defaultdict(list)
    for r in rows:
        sources[r[1]].append(r)
    ordered = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in ordered:
        own = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = (own, *tree([leaf(r) for r in own]))
    root, above = tree([trees[s][1] for s in ordered])
    out = []
    for s, upper in zip(ordered, above):
        own, subroot, paths = trees[s]
        for r, path in zip(own, paths):
            acc = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                acc = leaf((*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])))
            steps = path + upper
            for left, right in steps:
                acc = sha(left + acc + right)
            out.append((r[0], r[1], leaf(r), subroot, root, sha("".join(a + b for a, b in steps)), acc, acc == root))
    return sorted(out, key=repr)


def run(docs):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    out = merkle.manifest(docs, tampered, merkle.lower_ascii(F.col("text")))
    return sorted((tuple(r) for r in out.select(
        "doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp string, pos long, n long, digest string"


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "g", 1, 2, "d") for r in rows], SCHEMA).repartition(parts)


def test_manifest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(merkle, "TASK_ROWS", 100)
    rows = [(i, "hot", "en", i % 7, f"Text {i} Ñ") for i in range(700)]  # three levels, several windows and ranges
    rows += [(1000 + i, f"s{i % 20}", None, None, None if i % 4 else "A") for i in range(45)]
    rows += [(2000, None, "de", 1, "No Source"), (2001, "", "de", 1, ""), (None, "s1", "x", 0, "B"), (None, None, None, None, None),
             (1001, "s1", None, None, "B"), (1001, "s1", None, None, "B"), (2002, "ü", "de", 3, "long " * 60_000)]
    assert run(frame(spark, rows)) == brute(rows)


def test_small_and_empty_manifests(spark):
    for n in (1, 16, 17):
        rows = [(i, "one", "en", 1, "Abc") for i in range(n)]
        assert run(frame(spark, rows, 2)) == brute(rows)
    assert run(frame(spark, [(1, "one", "en", 1, "Abc")]).where("false")) == []


def test_edge_documents(spark, edge_docs):
    rows = [tuple(r) for r in edge_docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert run(edge_docs) == brute(rows)
