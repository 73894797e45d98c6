import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=200, vocab=400):
    rng = random.Random(seed)
    return " ".join(f"word{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, repeated rows and extra columns whose names clash."""
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n ", "en", "a", 4),
        (None, "a text without an id, of some length", "en", None, 10),
        (4, "short", "en", "a", 5),
        (5, prose(1, 60_000), "en", "b", 1),
        (6, prose(2), "en", "b", 1),
        (6, prose(2), "en", "b", 1),
        (7, prose(2), "de", "b", 1),
        (8, prose(3) + "\n" + prose(4) + "\n", "de", "c", 1),
        (9, "ünïcödé ßtraße 漢字 " * 30, "de", "c", 1),
        (10, "12 34 !!", None, "c", 8),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("size", "target", "copies", "lang_pred", "rejected", "score", "node", "class_id", "label", "queue", "part", "hash", "id", "n"):
        df = df.selectExpr("*", f"'x' as {name}")
    return df


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
