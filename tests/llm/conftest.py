from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, key string, rule string, u long, lines_gone string"
WORDS = "the of and river stone light under morning walks cold harbour letter seven open green table voice never early bridge".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, copies, repeated rows, more columns."""
    long = prose(9, 60_000)
    texts = [
        (1, prose(1, 80), "en"), (2, prose(1, 80), "en"), (3, None, "en"), (4, "", None), (5, " \n\t ", "en"), (6, long, "en"), (7, long + " end", "en"),
        (8, "one two", "en"), (8, "one two", "en"), (None, prose(2, 60), "en"), (9, prose(3, 60), None), (10, "漢字 のみ", "ja"), (11, "!!! ???", "en"), (12, "\x1c\x00﻿", "en"),
    ]
    rows = [(i, t, lang, None if k % 3 else "s", None if k % 2 else 5, 0.5, 1, "k", "r", 2, "z") for k, (i, t, lang) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"
