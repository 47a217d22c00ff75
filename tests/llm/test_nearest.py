"""Nearest neighbours: exactness where all is verified, recall, ties, and rows that take no part."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillroster.llm.nearest import Cells, Projection, chi_square_quantile, nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, _id string, _x int, _p string, rank string"
#: A confidence so near to one that the test never stops a search.
ALL = Projection(confidence=1 - 1e-12, leaf=8, queries=7)


def plainly(rows: list[tuple], every: int, k: int) -> dict[int, list[tuple]]:
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(float)
    out = {}
    for i, v in zip(ids, x):
        if i % every == 0:
            scores = (v * x).sum(axis=1)
            out[int(i)] = [(int(ids[j]), float(scores[j])) for j in np.lexsort((ids, -scores)) if ids[j] != i][:k]
    return out


def ours(spark, rows: list[tuple], every: int = 5, k: int = 6, how: Projection = ALL) -> dict[int, list[tuple]]:
    df = spark.createDataFrame([(*r, "a", 1, "b", "c") for r in rows], SCHEMA).repartition(3)
    out: dict[int, list] = {}
    for r in sorted(nearest_neighbours(df, F.col("vec_id") % every == 0, k, how=how).collect()):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def vectors(n: int, width: int, seed: int = 1) -> list[tuple]:
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, width)).astype(np.float32) * rng.uniform(0.2, 3, (n, 1)).astype(np.float32)
    return [(i, v.tolist()) for i, v in enumerate(x)]


def same(got: dict, want: dict) -> None:
    assert {q: [i for i, _ in rows] for q, rows in got.items()} == {q: [i for i, _ in rows] for q, rows in want.items() if rows}
    assert all(math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12) for q in got for (_, a), (_, b) in zip(got[q], want[q]))


@pytest.mark.parametrize("n, width", [(300, 5), (90, 1), (4, 3)])
def test_all_rows_verified(spark, n, width):
    rows = vectors(n, width)
    same(ours(spark, rows), plainly(rows, 5, 6))


def test_copies_ties_and_rows_that_take_no_part(spark):
    rows = vectors(60, 3) + [(1000 + i, [1.0, 2.0, -1.0]) for i in range(150)]
    odd = [(None, [1.0] * 3), (500, None), (505, [0.0] * 3), (510, [1.0, None, 1.0]), (515, [float("nan"), 1.0, 1.0]), (520, [1.0, 1.0, float("-inf")]), (525, [1.0] * 4), (530, [])]
    same(ours(spark, rows + odd + [rows[5], rows[5], (10, [9e9] * 3)]), plainly(rows, 5, 6))
    assert ours(spark, []) == {} and ours(spark, odd) == {} and ours(spark, [(5, [1.0, 1.0])]) == {}


def test_recall_with_the_test_that_stops(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 32))
    x = np.concatenate([rng.standard_normal((1500, 32)), centres.repeat(40, axis=0) + 0.15 * rng.standard_normal((1600, 32))])
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    got, want = ours(spark, rows, 25, 10, Projection()), plainly(rows, 25, 10)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values())) and all(len(got[q]) == 10 for q in want)


def test_quantiles_and_cells():
    assert abs(chi_square_quantile(0.95, 8) - 15.507) < 1e-3 and abs(chi_square_quantile(0.5, 2) - 2 * math.log(2)) < 1e-9
    points = np.random.default_rng(2).standard_normal((4096, 4))
    cells = Cells.of(points, 5).at(points)
    assert np.bincount(cells, minlength=32).tolist() == [128] * 32 and Cells.of(points, 0).at(points).max() == 0
