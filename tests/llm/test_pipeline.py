"""Every pipeline stage on the smallest documents against brute force, each judged on its own input."""

import re
from collections import Counter, defaultdict
from hashlib import sha256

import public_tokenizers
import pytest
import regex
from test_order_minhash import distance
from tokenizers import Tokenizer

import corpus_pipeline

WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    """Rows of documents and of the result of every stage."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs.collect())
    return out


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_language_stage_drops_texts_without_a_letter(tables):
    columns = corpus_pipeline.COLUMNS
    want = [tuple(r[c] for c in columns) for r in tables[0] if r["text"] and regex.search(r"\p{L}", r["text"])]
    assert sorted(want, key=repr) == plain(tables[1])


def test_near_duplicate_stage_keeps_one_of_each_class(tables):
    rows = tables[1]
    words = [re.findall(WORD, r["text"]) for r in rows]
    bags = [Counter(w) for w in words]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = max(len(words[i]), len(words[j]))
            if find(i) == find(j) or not words[i] or not words[j] or n - (bags[i] & bags[j]).total() > 0.2 * n:
                continue
            if distance(words[i], words[j]) <= 0.2 * n:
                parent[find(i)] = find(j)
    best = defaultdict(list)
    for k, r in enumerate(rows):
        best[find(k)].append(r)
    assert plain(min(g, key=lambda r: r["doc_id"]) for g in best.values()) == plain(tables[2])
    assert len(tables[2]) < len(rows)


def test_substring_stage_removes_repeated_windows(tables):
    starts = Counter()
    words = {r["doc_id"]: re.findall(WORD, r["text"]) for r in tables[2]}
    for w in words.values():
        starts.update(tuple(w[i:i + 35]) for i in range(len(w) - 34))
    got = {r["doc_id"]: re.findall(WORD, r["text"] or "") for r in tables[3]}
    for doc_id, w in words.items():
        gone = {j for i in range(len(w) - 34) if starts[tuple(w[i:i + 35])] > 1 for j in range(i, i + 35)}
        assert got[doc_id] == [x for j, x in enumerate(w) if j not in gone], doc_id
    assert len(got) == len(tables[3]) == len(tables[2])


def test_mixing_stage_returns_whole_documents_up_to_the_limit(tables):
    had, mixed = {tuple(r) for r in tables[3]}, Counter(tuple(r) for r in tables[4])
    assert set(mixed) <= had
    size = lambda r: len(re.findall(WORD, r[1] or ""))
    before, after = Counter(), Counter()
    for r in had:
        before[r[3]] += size(r)
    for r, n in mixed.items():
        after[r[3]] += n * size(r)
    longest = max(map(size, had))
    assert all(after[s] <= 1.25 * before[s] + longest for s in before)
    assert abs(sum(after.values()) - sum(before.values())) <= longest * len(before)


def test_bpe_stage_equals_the_library(tables):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        library = Tokenizer.from_str(f.read())
    texts = {r["doc_id"]: r["text"] or "" for r in tables[4]}
    assert len(tables[5]) == len(tables[4])
    for r in tables[5]:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
