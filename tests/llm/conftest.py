"""Rows that every operator has to live with."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _text string, score double, _size long"


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioustrnlm") for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows; the extra columns clash with names that operators use inside."""
    rng = random.Random(3)
    long = prose(rng, 6000)
    base = prose(rng, 60)
    texts = [None, "", " \n\t ", "one", base, base, base.replace(" ", "\n"), base + " more words follow here", long, long[:20_000], "x" * 30_000, "é ü ß 漢字     end", "a b c " * 40]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 3}", None, "clash", None, 1.0, -1) for i, t in enumerate(texts)]
    rows += [(4, base, "en", "s1", 5, "clash", None, 1.0, -1)] * 2  # repeated rows with an id in use
    return rows + [(None, base, "en", None, 5, None, "t", None, None), (None, "short text", None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
