"""Small documents tables for the tests of the training-data operators."""

from __future__ import annotations

import random
from collections.abc import Callable

import pytest
from pyspark.sql import DataFrame, SparkSession

#: Extra columns whose names clash with those that operators make for themselves.
CLASHING = "_id string, _tag int, _text string, _name long, score string"


@pytest.fixture(scope="session")
def make(spark: SparkSession) -> Callable[..., DataFrame]:
    """make([(doc_id, text, ...)], "more columns") -> a documents table with clashing extra columns."""

    def frame(rows: list[tuple], more: str = "") -> DataFrame:
        return spark.createDataFrame([(*r, "a", 1, "b", 2, "c") for r in rows], f"doc_id long, text string, {more + ', ' if more else ''}{CLASHING}").repartition(3)

    return frame


@pytest.fixture
def prose() -> Callable[[int], str]:
    """prose(n) -> n invented words; the same in each test."""
    rng = random.Random(11)
    lexicon = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    return lambda n: " ".join(rng.choice(lexicon) for _ in range(n))
