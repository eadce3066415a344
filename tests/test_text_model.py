"""Vocabulary of the text model and full settings of the tree models."""

from pyspark.sql import functions as F

from trailcast.operators import models as MD


def test_words_and_pairs_share_one_vocabulary(spark):
    rows = spark.range(40).select(
        (F.col("id") / 40).alias("f__a"), (F.col("id") % 2).alias("y_fail"),
        F.lit("aa bb aa cc aa dd bb dd cc bb").alias(MD.TEXT_COLUMN))
    model = MD.fit("structured_plus_tfidf_logistic", rows, ["f__a"], iterations=2, vocabulary=4)
    vocabulary = {t for stage in model.pipeline.stages if hasattr(stage, "vocabulary") for t in stage.vocabulary}
    assert vocabulary == {"aa", "bb", "cc", "dd"}  # each comes more often than any pair


def test_boosting_uses_all_rows():
    """The boosted model has no row sampling; its settings are those of the roster."""
    assert (MD.BOOSTED.rounds, MD.BOOSTED.rate, MD.BOOSTED.l2, MD.BOOSTED.leaves) == (300, 0.08, 1.0, 31)
    assert not any("sampl" in name for name in vars(MD.BOOSTED))


def test_term_weights_equal_plain_python(spark):
    import math
    import re
    from collections import Counter

    from trailcast.operators import models as MD

    texts = ["", "one word word word", "Word one two", "two two two one one", "x y z", "word two word two"]
    rows = spark.createDataFrame([(float(i), t, float(i % 2), 1.0) for i, t in enumerate(texts)], "f__a double, f__text_blob string, _y double, _w double")
    fitted = MD.text_pipeline(["f__a"], len(texts), iterations=3).fit(rows)
    terms = [(w := re.findall(r"\b\w\w+\b", t.lower())) + [f"{a} {b}" for a, b in zip(w, w[1:])] for t in texts]
    seen = Counter(term for t in terms for term in set(t))
    vocabulary = next(s.vocabulary for s in fitted.stages if hasattr(s, "vocabulary"))
    assert set(vocabulary) == {t for t, n in seen.items() if n >= 2}
    for r, own in zip(fitted.transform(rows).orderBy("f__a").collect(), terms):
        want = {t: (1 + math.log(n)) * (1 + math.log((1 + len(texts)) / (1 + seen[t]))) for t, n in Counter(own).items() if seen[t] >= 2}
        length = math.sqrt(sum(v * v for v in want.values()))
        got = {vocabulary[i]: v for i, v in zip(r["term_weights"].indices.tolist(), r["term_weights"].values)}
        assert got.keys() == want.keys()
        assert all(abs(got[t] - want[t] / length) < 1e-12 for t in want)
