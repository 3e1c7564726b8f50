import random

import pytest

WORDS = [a + b for a in ("ba", "ke", "li", "mo", "su", "ta", "ne", "ro", "pi", "du") for b in ("n", "r", "st", "lo", "mi", "ka", "ve")]


@pytest.fixture
def prose():
    """Seeded invented prose of n words."""

    def words(n: int, seed: int) -> str:
        drawn = random.Random(seed)
        return " ".join(drawn.choice(WORDS) for _ in range(n))

    return words


@pytest.fixture
def docs_of(spark):
    """documents from (doc_id, text) pairs, with further columns whose names operators use inside."""

    def frame(pairs, lang="en"):
        rows = [(i, t, lang, "s", "x", 1, "y") for i, t in pairs]
        return spark.createDataFrame(
            rows, "doc_id long, text string, lang string, source string, digest string, salt int, text_key string"
        )

    return frame


@pytest.fixture
def no_docs(docs_of):
    return docs_of([])
