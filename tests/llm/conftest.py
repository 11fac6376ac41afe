import random

import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Few documents with nulls, empty and long texts, copies, repeated rows and clashing column names."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))

    def text(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    rows = [(i, text(rng.randrange(5, 90)), "en", f"s{i % 4}") for i in range(40)]
    rows += [(100 + i, f"{text(7)} {passage}\n{text(5)}", "en", None) for i in range(12)]
    rows += [(200 + i, rows[3][1], "de", "s0") for i in range(6)]
    rows += [(300, None, None, "s1"), (301, "", "fr", "s1"), (302, " \t\n", None, "s2"), (303, text(3000), "en", "s2")]
    rows += [(304, "a a a a " * 30, "en", "s3"), (305, "Ünï çödé  x y " * 9, None, "s3"), rows[7], rows[7]]
    schema = "doc_id long, text string, lang string, source string"
    named = ("row", "words", "bin", "same", "shard", "votes", "spans")
    frame = spark.createDataFrame(rows, schema)
    for name in named:
        frame = frame.selectExpr("*", f"'clash' AS `{name}`")
    return frame.repartition(4)


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)
