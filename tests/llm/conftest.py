"""Small tables with nulls, empty and long texts, ties, repeated rows and columns of clashing names."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, key string, node string, tile int, bucket int, shard int, chunk int, _chunk int, rk string, digest string"


def make_docs(spark, rows):
    """(doc_id, text, source) rows with further columns under names that operators use themselves."""
    full = [(i, t, "en", s, len(t or ""), 7, "k", "x", 1, 2, 3, 4, 5, "r", "d") for i, t, s in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def awkward():
    """(doc_id, text, source) rows."""
    rng = random.Random(5)
    base = prose(rng, 300)
    near = base.split(" ")
    near[150] = "other"
    rows = [(i, prose(rng, rng.choice([1, 2, 3, 40, 200])), f"s{i % 4}") for i in range(20)]
    rows += [(100, base, "s0"), (101, base, "s1"), (102, base.replace(" ", "\t\n"), "s0"), (103, base.upper(), None), (104, " ".join(near), "s1")]
    rows += [(200, None, "s0"), (201, "", None), (202, " \n\t ", "s2"), (203, None, None), (None, base, "s0"), (None, None, None)]
    rows += [(300, "tie tie tie tie", "s1"), (301, "tie tie tie tie", "s1"), (300, "tie tie tie tie", "s1"), (301, "other words of the same id", "s3")]
    rows += [(400, prose(rng, 30_000, 5000), "s3"), (401, "z" * 5000, "s3"), (402, "été \U0001f600    x", "é")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, awkward):
    return make_docs(spark, awkward)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
