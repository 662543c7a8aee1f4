"""Small documents with the cases every operator has to define."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies int, row string"


def made_documents(seed: int = 3, n: int = 120) -> list[tuple]:
    """Documents with nulls, empty and long texts, copies, repeated rows, clashing columns."""
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdeéß", k=draw.randint(1, 8))) for _ in range(80)]
    rows = []
    for i in range(n):
        text = draw.choice([" ", "\n"]).join(draw.choices(words, k=draw.randint(1, 60)))
        rows.append((i, text, draw.choice(["en", "de", None]), f"src{i % 4}", len(text), i, "x"))
    hot = "the same text in a third of all rows"
    rows += [(1000 + i, hot, "en", "src0", len(hot), None, None) for i in range(n // 2)]
    rows += [
        (2000, None, "en", "src1", None, 1, "a"),
        (2001, "", "en", None, 0, 1, "a"),
        (2002, " \t\n ", None, None, 4, 1, "a"),
        (None, "no id", "en", "src1", 5, 1, "a"),
        (None, "no id", "en", "src1", 5, 1, "a"),
        (2003, " ".join(words * 300), "en", "src2", None, 1, "a"),
        (2004, "w" * 50_000, "en", "src2", 50_000, 1, "a"),
    ]
    rows += [(3000, "one row many times", "en", "src3", 18, 1, "a")] * 20
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(made_documents(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
