from __future__ import annotations

import random

import pytest

SF = "/root/testdata/sf0.001"
#: Column names that operators use inside, here with contents of their own.
CLASHES = (
    *("rid", "name", "level", "score", "node", "component", "ids", "count", "sketch", "bin"),
    *("copy_key", "row_key", "_copy_key", "_row_key"),
)

WORDS = ["alpha", "Beta", "gamma,", "delta", "épsilon", "zeta", "Eta.", "theta", "iota", "kappa"]


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(words))


@pytest.fixture(scope="session")
def sf() -> str:
    return SF


@pytest.fixture(scope="session")
def hard_rows() -> list[tuple]:
    """Nulls, empties, ties, repeated rows, copies, near copies and a very long text."""
    base = prose(1, 200)
    near = base.split()
    near[100] = "changed"
    rows = [
        (1, base),
        (2, base.encode().upper().decode()),  # A-Z alone
        (3, " ".join(near)),
        (3, " ".join(near)),
        (4, None),
        (5, ""),
        (5, ""),
        (6, " \n\t "),
        (7, "one two"),
        (8, "ONE  two"),
        (None, prose(2, 40)),
        (None, prose(2, 40)),
        (9, prose(3, 30_000)),
        (10, prose(3, 30_000) + " more"),
        (11, "x" * 20_000),
        (12, "İſK É ß <|endoftext|> \x1c\x85  中文 😀"),
        (13, "!!! ??? 123"),
        # Rows that read the same where null and the border of a column are not marked.
        (None, "14|abc def"),
        (14, "abc def"),
        (None, "15"),
        (15, None),
        (None, "2:16"),
        (16, ""),
    ]
    return [(i, t, "en" if n % 2 else None) for n, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(hard_rows, "doc_id long, text string, lang string")
    return docs.select("*", *[F.lit(c).alias(c) for c in CLASHES]).repartition(3)


@pytest.fixture(scope="session")
def nothing(hard):
    return hard.limit(0)
