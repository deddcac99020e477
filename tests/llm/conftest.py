"""Small tables with nulls, empty and long texts, ties, copies and near copies."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["der", "thé", "of", "and", "ing", "ñu", "lorem", "ipsum", "ein", "x1", "zwei", "trois", "vier,", "five."]) + rng.choice(["", "a", "en", "s\n", "\t"]) for _ in range(n))


@pytest.fixture(scope="session")
def doc_rows():
    rng = random.Random(5)
    base = [prose(rng, 150) for _ in range(5)]
    rows = []
    for i in range(70):
        kind = i % 10
        b = rng.choice(base)
        if kind < 3:
            t = b
        elif kind < 6:
            w = b.split(" ")
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(["qq", "WORD", ""])
            t = " ".join(w)
        elif kind == 6:
            t = rng.choice([None, "", "  \n", "one", "Two words"])
        elif kind == 7:
            t = rng.choice(["ab", "la ", "é"]) * rng.randrange(0, 160)
        else:
            t = prose(rng, rng.randrange(1, 120)) + b[100:420]
        rows.append((None if i == 33 else i * 3, t, ["src0", "src1", None][i % 3]))
    rows.append((9, rows[5][1], "src0"))  # an id twice
    return rows


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    return spark.createDataFrame(doc_rows, "doc_id long, text string, source string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")
