"""Fixtures shared by these tests (imported by name: a second conftest would shadow the first)."""

import random

import pytest


@pytest.fixture(scope="session")
def texts():
    """Small corpus with copies, near copies, shared passages, blanks and nulls."""
    rng = random.Random(7)
    words = ["the", "of", "and", "Alpha", "beta", "gamma", "delta7", "Épsilon", "zeta,", "eta.", "on", "is", "a"]
    passage = " ".join(rng.choices(words, k=60))

    def prose(n):
        return "\n".join(" ".join(rng.choices(words, k=rng.randint(1, 25))) for _ in range(n))

    out = [prose(rng.randint(1, 6)) for _ in range(30)]
    out += [out[3], out[3], out[4] + " beta", out[5].replace("the", "of", 1)]
    out += [f"{prose(1)}\n{passage}\n{prose(1)}" for _ in range(4)]
    out += ["", "   \n ", None, None, "x", "x", "word " * 400, "é" * 150 + " ü", "a b c d"]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With extra columns whose names clash with those operators use."""
    rows = [(i, t, None if i % 5 == 0 else f"s{i % 3}", i, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, block int, `row` string").repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows, ids shared by different rows."""
    rows = [(None, "a b c d e f g h i j k l m n"), (None, None), (1, "same text"), (1, "same text"), (1, "other text"),
            (2, None), (2, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")
