"""Small tables for the tests of the pipeline operators."""

from __future__ import annotations

import random

WORDS = "the of and to in quick brown fox jumps over lazy dog river stone cloud tree".split()


def prose(seed: int, n: int, words: int = 5000) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" if rng.random() < 0.8 else rng.choice(WORDS) for _ in range(n))


def documents(spark, texts: list, first_id: int = 0):
    """(doc_id, text) with extra columns whose names clash with those that operators make."""
    rows = [(i, t, "src", 7, "x") for i, t in enumerate(texts, first_id)]
    return table(spark, rows, "doc_id bigint, text string, source string, n_words int, spans string")


def table(spark, rows: list, schema: str):
    return spark.createDataFrame(rows, schema)


EDGES = [None, "", " ", "a", "\n\n", "Straße ﬀ \U0001f600 é", "A" * 5000, "same same", "same same", "x" * 3 + "\0y"]
