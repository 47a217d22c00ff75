"""Connected components by alternating stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillroster.llm.common import materialise


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of longs -> (u, root) for every vertex but the roots; root is its component's smallest vertex.

    Each round points every vertex at the smallest vertex it has seen. Rounds grow as the logarithm
    of a component's width; every round is a written table. Smallest values are pre-aggregated, and
    in the joins both sides are exchanged, so that a vertex with very many neighbours can be split.
    """
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while (mark := _mark(now)) != before:
        before = mark
        # Larger neighbours move to the smallest neighbour or the vertex itself.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        large = materialise(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        # Smaller neighbours, and the vertex, move to the smallest neighbour.
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = materialise(moved.where("u <> v").distinct(), "small")
    return now.select("u", F.col("v").alias("root"))
