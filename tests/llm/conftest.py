import random

import pytest

#: doc_id, text of awkward rows: null and empty texts, ties, repeated rows, a row without id, a long text.
AWKWARD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one two"), (6, "same text here for all of us to see"), (7, "same text here for all of us to see"),
           (7, "same text here for all of us to see"), (None, "a row without an id but with some words in it"), (8, "Ünïcödé wörds — and more 漢字 🙂 end")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    syllables = ["ta", "ri", "mo", "ne", "lu", "ka", "so", "vi"]
    return " ".join("".join(r.choices(syllables, k=r.randint(2, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Awkward rows with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "x", 1, 2.0) for i, t in [*AWKWARD, (9, prose(9, 30_000))]]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, name long, kind double").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def frame(spark, rows, names="doc_id long, text string"):
    return spark.createDataFrame(rows, names)
