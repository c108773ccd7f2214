from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, ids string, part int, shard int, queue string, score double"


def words(rng: random.Random, n: int) -> str:
    parts = ["an", "the", "er", "on", "re", "st", "ha", "ing", "ou", "en", "tion", "ble"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    rng = random.Random(11)
    long = words(rng, 4000)
    base = [words(rng, 60) for _ in range(12)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    rows += [
        (20, None, None, None),
        (21, "", "en", "s0"),
        (22, " \n\t ", "en", "s0"),
        (23, long, "en", "s1"),
        (24, long + " end", "en", "s1"),
        (25, "123 456 !!", None, "s2"),
        (26, "x", "en", "s2"),
        (26, "x", "en", "s2"),
        (27, base[0], "en", "s0"),
        (27, base[0], "en", "s0"),
        (28, base[1] + " tail", "en", None),
        (None, base[2], "en", "s1"),
        (None, "only here", None, "s1"),
        (29, "x" * 30_000, "en", "s0"),
        (30, "ÀÉ́ 日本語 🙂    mixed\r\nlines\x00", "fr", "s0"),
        (31, base[3].upper(), "en", "s0"),
    ]
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), 1, "ids", 2, 3, None, 0.5) for i, t, lang, source in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
