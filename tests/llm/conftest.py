import pytest


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with further columns whose names the operators use inside."""

    def make(rows):
        wide = [(i, t, 1, "x", "y", 2) for i, t in rows]
        return spark.createDataFrame(wide, "doc_id long, text string, part int, key string, label string, n int")

    return make


ODD = [
    (1, None),
    (2, ""),
    (3, "   \n\n  \t"),
    (4, "one"),
    (5, "one"),
    (None, "a text without an id that is long enough to be looked at by every operator there is in here"),
    (6, "word " * 30_000),
    (7, "x" * 100_000),
    (8, "é漢字 👍 ́ İ ß  end"),
    (8, "é漢字 👍 ́ İ ß  end"),
]


@pytest.fixture
def odd():
    return list(ODD)
