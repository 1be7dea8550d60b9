import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """make(texts or (doc_id, text, source) rows): a documents table."""

    def build(rows):
        full = [(i, r, f"s{i % 3}") if r is None or isinstance(r, str) else r for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in full], SCHEMA)

    return build


@pytest.fixture(scope="session")
def prose():
    """prose(n, seed): n invented words."""
    import random

    def words(n, seed=0):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice(["an", "the", "er", "on", "ti", "re", "in", "sta"]) for _ in range(rng.randint(1, 4))) for _ in range(n))

    return words
