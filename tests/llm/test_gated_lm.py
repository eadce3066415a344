"""Which documents the rounds of the language model walk through."""

import uuid
from collections import Counter

from trailcast.llm import gated_lm


def test_every_training_document_is_walked_through_once(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)

    def recorder(shared):
        def run(batches):
            texts = [t for batch in batches for t in batch.column(0).to_pylist()]
            if texts:
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                    f.write("\n".join(texts))
            yield from ()

        return run

    rows = [(k, f"text number {k}") for k in range(60)] + [(100 + k, "one text many times") for k in range(30)]
    rows += [(None, "no id")] * 2
    training = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    counts = gated_lm.count(training)[0]
    monkeypatch.setattr(gated_lm, "_train", recorder)
    gated_lm.fit(training, counts)
    parts = [p.read_text().split("\n") for p in tmp_path.iterdir()]
    assert Counter(t for part in parts for t in part) == Counter(t for _, t in rows)
    assert sum("one text many times" in part for part in parts) == gated_lm.ROUNDS
