import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc struct<x:int>, family string"


def words(seed, n):
    import random

    pick = random.Random(seed)
    return " ".join("".join(pick.choices("abcdefghij", k=pick.randrange(2, 7))) for _ in range(n))


BASE = words(1, 300)
PASSAGE = words(2, 120)
ROWS = [
    (1, BASE),
    (2, BASE),  # a copy
    (3, BASE.replace(BASE.split()[150], "other", 1)),  # a near copy
    (4, words(3, 200) + " " + PASSAGE),
    (5, PASSAGE + "\n" + words(4, 80) + "\n" + PASSAGE),  # the passage twice
    (6, None),
    (7, ""),
    (8, "one two"),
    (9, "ONE\ttwo"),
    (10, " \n\t"),
    (11, "x" * 1500),  # a periodic text without white space
    (12, "été naïve 日本語 \U0001f600 don't 123  end " * 60),
    (13, words(5, 5000)),  # a long one
    (13, words(5, 5000)),  # a repeated row
    (None, BASE),
    (None, None),
]


def frame(spark, rows):
    full = [
        (i, t, ("en" if (i or 0) % 2 else "fr") if t else None, "s", len(t) if t else None, (1,), "f")
        for i, t in rows
    ]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return frame(spark, ROWS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
