"""Documents with everything that operators must bear: nulls, empty and long texts, copies, repeated rows, odd columns."""

from __future__ import annotations

import random

import pytest

#: Extra columns named like the operators' own.
CLASHING = "score size block shard copy place taken length offset part kind blob class tokens f label n_words vote_x seen kept quality_score_ target".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    stops = "the of and to in a is that for it".split()
    made = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(200)]
    out = [rng.choice(stops) if rng.random() < 0.35 else rng.choice(made) for _ in range(n)]
    return " ".join(w + ("." if i % 12 == 11 else "") for i, w in enumerate(out))


def hard_rows() -> list[tuple]:
    base = prose(1, 120)
    near = base.split(" ")
    near[60] = "changed"
    texts = [
        base, None, "", " \n\t ", prose(2, 30_000), base, base.upper(), " ".join(near), "one two three", "One  two\nthree", "ünï cödé 日本   x\ty",
        "a\n\nb\n \n", "<|endoftext|> text <|startoftext|>", "x" * 5000, "### $$$ ||| " * 40,
    ]
    rows = [(i, t, "en", [None, "s1", "s2"][i % 3], len(t) if t is not None else None) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[1], (None, "no id here", None, "s1", 10), (None, None, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def hard(spark):
    """The hard rows in several partitions."""
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(spark, hard):
    from pyspark.sql import functions as F

    return hard.withColumns({c: F.lit("own") for c in CLASHING})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def small_labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
