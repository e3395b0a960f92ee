from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos string, id string, count long"


def frame(spark, rows):
    """Documents from (doc_id, text, lang, source), with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "p", "q", 7) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(2, 9))) for _ in range(400)]


@pytest.fixture(scope="session")
def odd_rows(words):
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, and ordinary ones."""
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = "\n".join(text(40) for _ in range(400))
    rows = [(0, None, None, None), (1, "", "en", "b"), (2, " \n\t ", None, "b"), (None, "no id here at all", "en", "a"), (3, "one", "en", "a"), (4, "one", "de", None), (5, long, "en", "a"), (5, long, "en", "a")]
    base = text(60)
    rows += [(10 + i, base + f" w{i}", "en", "a") for i in range(6)] + [(20, base, "en", "c"), (21, base, "en", "c"), (22, "é" * 3000, "fr", "c"), (23, "x" * 5000, None, "b")]
    rows += [(30 + i, "\n".join(text(12) for _ in range(5)), "en" if i % 2 else "de", "ab"[i % 2]) for i in range(20)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return frame(spark, odd_rows).repartition(3).persist()


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])
