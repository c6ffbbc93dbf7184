import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, score double, token string"


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, short, very long, repeated and unusual texts."""
    rng = random.Random(3)
    long = sentence(rng, 30_000)
    plain = sentence(rng, 60)
    return [None, "", "  \t\n ", "one", "A b\x0bC\u00a0d  e", plain, plain, plain.upper(), "é ü ñ 中文 😀", "12 34 !!", long, long + " tail", "x " * 300]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    rows = [(i, t, None, None if i % 3 else f"s{i % 2}", None, 7, 0.5, "clash") for i, t in enumerate(odd_texts)]
    rows += [rows[5], rows[5], (None, "null id text here", "en", "s1", 3, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
