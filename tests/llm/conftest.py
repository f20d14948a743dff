import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of():
    """Makes a documents table of (doc_id, text) rows."""

    def make(spark, rows, source="s"):
        return spark.createDataFrame([(i, t, "en", source if isinstance(source, str) else source(i), len(t or "")) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and long texts, repeats."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    return [(1, "a b c d e f"), (2, None), (3, ""), (4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f"), (5, long), (6, long + " x"), (7, " \n "), (None, None)]


@pytest.fixture(scope="session")
def prose():
    def make(n, seed=0, words=400):
        r = random.Random(seed)
        vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(words)]
        return [" ".join(r.choice(vocabulary) for _ in range(r.randint(5, 60))) for _ in range(n)]

    return make
