"""Samples whose size doesn't grow with the table, and ids that are texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillroster.llm import quality as Q
from quillroster.llm.common import lowest
from quillroster.llm.queries import vocabulary
from quillroster.llm.token_files import token_files


def test_the_lowest_share_of_hashes_at_every_size(spark):
    for rows in (1e3, 1e6, 1e9, 1e11, 1e15):
        for bound in (1, 500, 6000):
            drawn = (lowest(bound / rows) + 2**63 + 1) / 2**64 * rows
            assert abs(drawn - min(bound, rows)) <= max(1e-3 * bound, rows / 2**63)
    assert lowest(1.0) == lowest(7.5) == 2**63 - 1 and lowest(0.0) == -(2**63)
    hashes = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    assert 340 < hashes.where(F.col("h") <= lowest(0.02)).count() < 460 and hashes.where(F.col("h") <= lowest(1.0)).count() == 20_000


def test_ids_that_are_texts_or_missing(spark, prose):
    rows = [(f"d{i}" if i % 7 else None, prose(30) if i % 2 else "BUY now !!! $$$ click " * 10) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(300)], "doc_id string, quality int")
    got = Q.quality(docs, labels).collect()
    assert len(got) == 300 and {r.doc_id for r in got} == {i for i, _ in rows} and len({r.score for r in got}) > 2
    with pytest.raises(ValueError, match="doc_id: ids have to be whole numbers"):
        token_files(docs, vocabulary("word_bpe_49k.json"))
