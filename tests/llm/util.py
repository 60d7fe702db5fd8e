"""Fixtures with the awkward rows: nulls, empty and long texts, repeats, clashing columns."""

import random

DOCS = "doc_id long, text string, lang string, bucket int, id long, sig long, hash long, data binary"


def prose(rng, n, vocabulary=2000):
    return " ".join(f"w{rng.randrange(vocabulary)}x{'abcdefgh'[rng.randrange(8)]}" for _ in range(n))


def awkward(extra=(), seed=5):
    """Rows for ``DOCS``."""
    rng = random.Random(seed)
    long = prose(rng, 30_000)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "two words"), (6, long), (None, "no id " * 40), (None, None), *extra]
    rows += [(100 + i, prose(rng, rng.choice([3, 10, 60, 300]))) for i in range(25)]
    rows += [rows[5], (100, rows[-25][1])]  # repeated rows
    return [(i, t, None if i == 4 else "en", 7, 8, None, 9, b"x") for i, t in rows]


def docs(spark, extra=(), seed=5):
    return spark.createDataFrame(awkward(extra, seed), DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)
