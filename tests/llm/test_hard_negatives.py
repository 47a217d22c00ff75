"""Hard negatives against plain loops over all pairs."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from quillroster.llm.hard_negatives import Mining, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, _id string, _x int, _part string, rank string"
SMALL = Mining(anchors=3, rows=17, chunk=3)


def plainly(rows: list[tuple], every: int, how: Mining) -> list[tuple]:
    ints = {i: ([math.floor(how.scale * x) for x in v], label) for i, v, label in rows}
    score = lambda a, b: sum(x * y for x, y in zip(ints[a][0], ints[b][0]))
    out = []
    for a in ints:
        if a % every:
            continue
        others = sorted(((-score(a, b), b) for b in ints if b != a))
        for s, p in [x for x in others if ints[x[1]][1] == ints[a][1]][: how.positives]:
            window = [(n, x) for n, x in others if ints[x][1] != ints[a][1] and how.low * -s <= 100 * -n <= how.high * -s]
            out += [(a, p, k + 1, x, -s, -n) for k, (n, x) in enumerate(window[: how.negatives])]
    return sorted(out)


def ours(spark, rows: list[tuple], every: int = 4, how: Mining = SMALL) -> list[tuple]:
    df = spark.createDataFrame([(*r, "a", 1, "b", "c") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, hard_negatives(df, F.col("vec_id") % every == 0, F.col("label"), how=how).collect()))


def vectors(n: int, width: int, labels: int = 3) -> list[tuple]:
    rng = random.Random(n)
    return [(i, [rng.randint(-40, 60) / 64 for _ in range(width)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("width", [1, 3, 7, 40])
def test_all_pairs(spark, width):
    rows = vectors(70, width)
    want = plainly(rows, 4, SMALL)
    assert want and ours(spark, rows) == want


def test_rows_that_take_no_part_ties_and_repeats(spark):
    rows = vectors(40, 4, 2) + [(100 + i, [0.5, 0.25, 0.5, 0.0], i % 2) for i in range(30)]
    odd = [(None, [1.0] * 4, 0), (200, None, 0), (204, [1.0, None, 1.0, 1.0], 1), (208, [float("nan"), 1.0, 1.0, 1.0], 1), (212, [float("inf"), 1.0, 1.0, 1.0], 1), (216, [1.0] * 4, None), (220, [9.0] * 5, 1), (224, [], 1)]
    repeats = [rows[4], rows[4], (8, [9.0] * 4, 1) if rows[8][2] == 0 else (8, [9.0] * 4, 2)]
    assert ours(spark, rows + odd + repeats) == plainly(rows, 4, SMALL)


def test_large_components_and_nothing_to_do(spark):
    large = [(i, [x * 1e5 for x in v], label) for i, v, label in vectors(30, 5)]
    stored = [(i, list(map(float, map(__import__("numpy").float32, v))), label) for i, v, label in large]
    assert ours(spark, large) == plainly(stored, 4, SMALL)
    with pytest.raises(ValueError):
        ours(spark, [(0, [1e12, 1e12], 1), (1, [1e12, 1.0], 1)])
    assert ours(spark, []) == [] and ours(spark, [(1, [1.0], 1)]) == [] and ours(spark, [(0, [1.0], 1), (4, [1.0], 2)]) == []
