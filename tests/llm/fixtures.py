"""Small tables with the cases that every operator must stand."""

from __future__ import annotations

import random

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, rid string, word string, count long, component long"


def documents(spark, rows):
    """A documents table from (doc_id, text), with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", None, None, "x", None, 1, 5) for i, t in rows], SHAPE)


def prose(seed: int, n: int, words: int = 400) -> str:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(words)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def hard_rows() -> list[tuple[int | None, str | None]]:
    long = prose(1, 12_000)
    return [(1, None), (2, ""), (3, "   \n\n "), (4, "!!! ??? ..."), (5, long), (6, long), (None, "no id at all here"), (None, None), (7, "one"), (7, "one"), (8, "Ünïcode 漢字 😀 текст ﷺ"), (9, "a" * 50_000), (10, "1 " * 20_000), (11, "<|endoftext|> and <|startoftext|>x")]
