import random

import pytest

ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "s1"), (2, None, None, None), (3, "", "en", "s1"), (4, " \n\t ", "de", "s2"),
    (5, "one", "en", "s2"), (5, "one", "en", "s2"), (None, "a row without an id has words too", "fr", None), (6, "é" * 30 + " ünï ключ 日本", "de", "s1"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty texts, repeated rows, a very long text, columns named like the operators' own."""
    rng = random.Random(3)
    long = " ".join("".join(rng.choices("abcde", k=rng.randint(1, 9))) for _ in range(60_000))
    rows = [(*r, 7, "x", 1.5) for r in [*ODD, (9, long, "en", "s1")]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, row string, size double").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def rows(df):
    return {(r["doc_id"]): r for r in df.collect()}
