"""Fixtures of the training-data operators: awkward documents and tables on disk."""

import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators may use inside
        T.StructField("rank", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("deleted", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("hub", T.LongType()),
    ]
)


def sentence(rng: random.Random, words: int, alphabet: str = "abcdefghijklmnopqrstuvwxyz") -> str:
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 8))) for _ in range(words))


def awkward_texts() -> list[tuple[int | None, str | None, str | None]]:
    rng = random.Random(5)
    shared = sentence(rng, 60)
    base = sentence(rng, 120)
    edited = base.split()
    edited[3] = "changed"
    far = base.split()
    for k in range(0, 120, 6):
        far[k] = "other"
    rows = [
        (1, None, "en"), (2, "", "en"), (3, " \t\n ", "en"), (4, "one", "en"), (5, "One", "en"), (6, "1234 5678", None),
        (7, base, "en"), (8, base.upper(), "en"), (9, " ".join(edited), "en"), (10, " ".join(far), "en"), (11, base, "en"), (11, base, "en"),
        (12, f"{sentence(rng, 30)}\n{shared}\n{sentence(rng, 30)}", "fr"), (13, f"{sentence(rng, 40)}\n{shared}\n\n{sentence(rng, 20)}", "fr"),
        (14, f"{shared}\n{shared}", "fr"), (15, "a b c d", None), (16, "A  b\nc d", None), (17, "été ünïcödé 漢字 <|endoftext|> 😀", "fr"),
        (18, "\n".join(sentence(rng, 5) for _ in range(3000)), "de"), (19, "x" * 5000, "de"), (20, "word " * 4000, "de"),
        (None, base, "en"), (None, None, None), (-3, sentence(rng, 50), "es"),
    ]
    rows += [(100 + k, sentence(rng, 40, "abcdef" if k % 2 else "uvwxyz"), "en" if k % 2 else "de") for k in range(40)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(i, t, g, "src", len(t) if t is not None else None, "r", "s", 1, "d", 2, 3) for i, t, g in awkward_texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
