"""The language stage drops only what has no language."""

from trailcast.llm import language_id


def test_unsure_short_texts_are_kept(spark):
    rows = [(k, "abc abd", lang) for k, lang in enumerate(["l1", "l2", "l3"])]  # three alike languages: posterior 1/3
    rows += [(3, "abc", None), (4, "123", None), (5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in language_id.keep_identified(docs).collect()} == {0, 1, 2, 3}


def plain_bayes(train, texts):
    """Naive Bayes with dictionaries over the operator's buckets: language and posterior."""
    import math
    from collections import Counter

    counts, documents = {}, Counter(lang for _, lang in train)

    def grams(text):
        for _, _, points, _ in language_id._batches([text]):
            for bucket in language_id._buckets(points):
                yield from bucket.tolist()

    for text, lang in train:
        counts.setdefault(lang, Counter()).update(grams(text))
    out = []
    for text in texts:
        if not text or not any(c.isalpha() for c in text):
            out.append(("und", 0.0))
            continue
        logs = {}
        for lang, seen in counts.items():
            whole = sum(seen.values()) + language_id.BUCKETS
            logs[lang] = math.log(documents[lang] / len(train)) + sum(math.log((seen[g] + 1) / whole) for g in grams(text))
        best = max(sorted(logs), key=logs.get)
        out.append((best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())))
    return out


def test_predictions_equal_plain_bayes_in_one_block_and_in_many(spark, monkeypatch):
    import random

    import pytest

    rng = random.Random(6)
    letters = {f"l{k}": "".join(rng.sample("abcdefghijklmnopqrstuvwxyzé", 9)) for k in range(7)}
    word = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 7)))
    train = [(" ".join(word(lang) for _ in range(12)), lang) for lang in letters for _ in range(6)]
    texts = [" ".join(word(lang) for _ in range(3)) for lang in letters for _ in range(3)] + ["", None, "123", "zz", "zz", "é" * 3000]
    want = plain_bayes(train, texts)
    labelled = spark.createDataFrame(train, "text string, lang string")
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, lang_pred string").repartition(3)
    for size in (128, 3, 1):
        monkeypatch.setattr(language_id, "MAX_LANGUAGES", size)
        model = language_id.fit(labelled)
        assert len(model) == -(-7 // size)
        got = language_id.identify(docs, model).orderBy("id").collect()
        assert [r["lang_pred"] for r in got] == [w[0] for w in want]
        assert [r["score"] for r in got] == pytest.approx([w[1] for w in want], abs=1e-9)


def test_more_languages_than_a_block(spark):
    names = [f"lang{k:03}" for k in range(200)]
    rows = [(k, f"{chr(0x4E00 + 3 * k)}{chr(0x4E01 + 3 * k)} " * 4, name) for k, name in enumerate(names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(docs, language_id.fit(docs)).collect()
    assert all(r["lang_pred"] == r["lang"] for r in got) and len(got) == 200
