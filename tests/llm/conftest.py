import pytest

#: Texts that every operator on documents must stand: null, empty, spaces, no letter, repeats, long.
EDGE_TEXTS = [None, "", "   \n\t", "123 456 !!", "same words here", "same words here", "same  words\nhere",
              "wörter ñandú 漢字 🙂", "long " * 30_000]


@pytest.fixture(scope="session")
def edge_docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s0" if i % 3 else None, 0) for i, t in enumerate(EDGE_TEXTS)]
    rows += [(4, "same words here", "en", "s0", 0), (None, "no id at all", "en", "s0", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
