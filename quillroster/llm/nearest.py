"""Approximate nearest neighbours by largest inner product: stable projections to few dimensions, in a kd-tree.

A vector x is scaled by the largest norm and gets one more component, so that all have length one; a
query is scaled to length one. Nearness by inner product is then nearness by distance. Projected on m
vectors of independent normal values (a 2-stable law), a distance d becomes d times the root of a
chi-square variable of m degrees. A query therefore looks at its neighbours in the order of their
projected distance, leaf after leaf of a kd-tree, verifies them on the original vectors, and stops
where the projected distance is so large beside that of its k-th best so far that, by the chi-square
law, anything nearer would with the asked confidence have been met before.

The tree's upper part is cut on a bounded sample, its cells are shared out as pieces of bounded size, and each
piece has the lower part, down to its leaves. A query first visits the cell it lies in; the k-th best found there
says which other cells the test still lets it visit, and it takes that score along to them. Pieces and
blocks of queries meet in a shuffle: neither the index nor the queries are ever in one place.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillroster.llm.common import materialise
from quillroster.llm.vectors import column, commonest_length, finite, lists, matrix

RESULT = "query_id long, rank int, vec_id long, score double"
FOUND = "_query long, _found long, _score double"
#: Beside a score or a squared distance of vectors of length one: what rounding may do to them.
SLACK = 1e-9


@dataclass(frozen=True)
class Projection:
    """degrees: the projected dimensions (even). sample: rows that the cells are cut on, at most. A piece has
    a 64th of all rows, but at most `piece`; a tree has at most `cells` cells; a task gets about `queries` queries at a time."""

    degrees: int = 8
    confidence: float = 0.98
    leaf: int = 128
    piece: int = 16384
    cells: int = 4096
    sample: int = 65536
    queries: int = 1024
    seed: int = 20

    def basis(self, width: int) -> np.ndarray:
        return np.random.default_rng(self.seed).standard_normal((width + 1, self.degrees))


def chi_square_quantile(share: float, degrees: int) -> float:
    """Where the chi-square distribution of an even number of degrees reaches share."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))
    low, high = 0.0, 1.0
    while below(high) < share:
        high *= 2
    for _ in range(60):
        low, high = ((low + high) / 2, high) if below((low + high) / 2) < share else (low, (low + high) / 2)
    return high


def projected(x: np.ndarray, peak: float | None, basis: np.ndarray) -> np.ndarray:
    """Indexed vectors, by the largest norm, peak; or, without it, queries."""
    if peak is None:
        return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ basis[:-1]
    scaled = x / peak
    rest = np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(axis=1)))
    return scaled @ basis[:-1] + rest[:, None] * basis[-1]


@dataclass
class Cells:
    """The upper tree, in heap order: which projected component a node looks at, and the value beyond which a point goes right."""

    axis: np.ndarray
    cut: np.ndarray

    @staticmethod
    def of(points: np.ndarray, depth: int) -> Cells:
        axis, cut, parts = [], [], [points]
        for _ in range(depth):
            following = []
            for part in parts:
                a = int(np.argmax(np.ptp(part, axis=0))) if len(part) else 0
                c = float(np.median(part[:, a])) if len(part) else 0.0
                axis.append(a)
                cut.append(c)
                following += [part[part[:, a] <= c], part[part[:, a] > c]] if len(part) else [part, part]
            parts = following
        return Cells(np.array(axis, np.int64), np.array(cut))

    def at(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(len(self.axis).bit_length()):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.cut[node])
        return node - len(self.axis)


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point from each box, 0 within it."""
    out = np.zeros((len(points), len(low)))
    for k in range(points.shape[1]):
        p = points[:, k, None]
        out += np.maximum(np.maximum(low[:, k] - p, p - high[:, k]), 0) ** 2
    return out


def _leaves(points: np.ndarray, most: int) -> np.ndarray:
    """The leaf of each point: halves at the median of the widest component, until a leaf has `most` points at most."""
    leaf, waiting, n = np.zeros(len(points), np.int32), [np.arange(len(points))], 0
    while waiting:
        part = waiting.pop()
        if len(part) <= most:
            leaf[part] = n
            n += 1
            continue
        axis = int(np.argmax(np.ptp(points[part], axis=0)))
        order = np.argpartition(points[part, axis], len(part) // 2)
        waiting += [part[order[len(part) // 2 :]], part[order[: len(part) // 2]]]
    return leaf


def _better(k: int, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, best: np.ndarray, best_ids: np.ndarray) -> None:
    """Puts (row, score, id) into the k best of the rows, ties to the smaller id."""
    touched = np.unique(rows)
    old = np.repeat(touched, k)
    rows, scores, ids = np.concatenate([rows, old]), np.concatenate([scores, best[touched].ravel()]), np.concatenate([ids, best_ids[touched].ravel()])
    order = np.lexsort((ids, -scores, rows))
    rows, scores, ids = rows[order], scores[order], ids[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    top = place < k
    best[rows[top], place[top]], best_ids[rows[top], place[top]] = scores[top], ids[top]


def _products(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows of a and b, the same for the same vectors wherever they are."""
    step = max(1, (1 << 21) // max(1, a.shape[1]))
    return np.concatenate([(a[i[s : s + step]] * b[j[s : s + step]]).sum(axis=1) for s in range(0, len(i), step)] or [np.zeros(0)])


def best_of_piece(k: int, reach: float, peak: float, asked: tuple[np.ndarray, ...], piece: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """asked: ids, vectors, projections and scores to beat; piece: ids, vectors, projections and leaves, in the order of the leaves -> scores and ids of the k best of each query."""
    ids, queries, at, floor = asked
    known, vectors, points, leaf = piece
    begins = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
    ends = np.r_[begins[1:], len(leaf)]
    far = box_distance(at, np.minimum.reduceat(points, begins), np.maximum.reduceat(points, begins))
    order = np.argsort(far, axis=1, kind="stable")
    length = np.linalg.norm(queries, axis=1) * peak
    best, best_ids = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
    live = np.arange(len(ids))
    for step in range(len(begins)):
        leaves = order[live, step]
        least = np.maximum(best[live, k - 1], floor[live])
        # The chi-square test: past this leaf's distance nothing nearer than the k-th best is to be expected.
        on = far[live, leaves] <= reach * (2 - 2 * least / length[live] + SLACK)
        live, leaves = live[on], leaves[on]
        if not len(live):
            break
        by = np.argsort(leaves, kind="stable")
        for group in np.split(by, np.flatnonzero(np.diff(leaves[by])) + 1):
            mine, b, e = live[group], begins[leaves[group[0]]], ends[leaves[group[0]]]
            scores = queries[mine] @ vectors[b:e].T
            scores[known[b:e] == ids[mine, None]] = -np.inf
            least = np.maximum(best[mine, k - 1], floor[mine])
            if e - b > k:
                least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
            i, j = np.nonzero((scores >= (least - SLACK * length[mine])[:, None]) & (scores > -np.inf))
            _better(k, mine[i], _products(queries, mine[i], vectors, b + j), known[b + j], best, best_ids)
    return best, best_ids


def _searched(k: int, reach: float, peak: float, width: int, degrees: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def searched(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["_query", "_found", "_score"]
        if not left.num_rows or not right.num_rows:
            return pa.schema([("_query", pa.int64()), ("_found", pa.int64()), ("_score", pa.float64())]).empty_table()
        order = np.lexsort((column(right, "_id"), column(right, "_leaf", np.int32)))
        piece = column(right, "_id")[order], matrix(right.column("_x"), np.float64, width)[order], matrix(right.column("_p"), np.float64, degrees)[order], column(right, "_leaf", np.int32)[order]
        asked = column(left, "_query"), matrix(left.column("_qx"), np.float64, width), matrix(left.column("_qp"), np.float64, degrees), column(left, "_floor", np.float64)
        best, found = best_of_piece(k, reach, peak, asked, piece)
        some = best > -np.inf
        return pa.table([np.repeat(asked[0], some.sum(axis=1)), found[some], best[some]], names)

    return searched


@dataclass
class Index:
    """rows: _cell, _piece, _leaf, _id, _x, _p. cells (one row each): _cell, _pieces. low, high: the cells' boxes, in the order of `numbers`."""

    rows: DataFrame
    cells: DataFrame
    numbers: np.ndarray
    low: np.ndarray
    high: np.ndarray
    peak: float
    width: int
    how: Projection


def usable(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(_id, _x), the vectors that take part, one for each id; and their length (0: there are none)."""
    norm = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)
    rows = df.where(F.col(id_col).isNotNull() & finite(vector_col)).select(F.col(id_col).cast("long").alias("_id"), F.transform(vector_col, lambda x: x.cast("double")).alias("_x")).where((norm("_x") > 0) & (norm("_x") < float("inf")))
    width = commonest_length(rows, "_x") or 0
    return materialise(rows.where(F.size("_x") == width).groupBy("_id").agg(F.min("_x").alias("_x")), "vectors"), width


def _mapped(made: Callable[[pa.RecordBatch], dict[str, pa.Array]], kept: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Columns made of each batch beside those that are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                more = made(batch)
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], *more.values()], names=[*kept, *more])

    return run


def build_index(vectors: DataFrame, width: int, how: Projection = Projection()) -> Index | None:
    """vectors: as usable() gives them; None where there are none. Cells are cut on a sample of bounded size; every vector is indexed."""
    norm = F.sqrt(F.aggregate("_x", F.lit(0.0), lambda s, v: s + v * v))
    n, peak = vectors.agg(F.count("*"), F.max(norm)).first()
    if not n:
        return None
    peak, basis, most = float(peak) * (1 + 1e-12), how.basis(width), max(1, min(how.piece, -(-n // 64)))
    depth = max(0, min(how.cells, n // most).bit_length() - 1)
    mark, share = F.xxhash64(F.lit(how.seed), "_id"), min(1.0, 2 * how.sample / n)
    few = vectors.where(mark <= min(2**63 - 1, int(share * 2**64) - 2**63)).orderBy(mark, "_id").limit(how.sample).select("_x")
    points = few.mapInArrow(_mapped(lambda b: {"_p": lists(projected(matrix(b.column(0), np.float64, width), peak, basis))}, ()), "_p array<double>").toArrow()
    tree = Cells.of(matrix(points.column("_p"), np.float64, how.degrees), depth)

    def placed(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        p = projected(matrix(batch.column(1), np.float64, width), peak, basis)
        return {"_p": lists(p), "_cell": pa.array(tree.at(p).astype(np.int32))}

    in_cells = materialise(vectors.select("_id", "_x").mapInArrow(_mapped(placed, ("_id", "_x")), "_id long, _x array<double>, _p array<double>, _cell int"), "placed")
    edge = lambda f, name: F.array(*[f(F.col("_p")[k]) for k in range(how.degrees)]).alias(name)
    cells = materialise(in_cells.groupBy("_cell").agg(F.ceil(F.count("*") / most).cast("int").alias("_pieces"), edge(F.min, "_low"), edge(F.max, "_high")), "cells")
    boxes = cells.orderBy("_cell").toArrow()  # how.cells rows at most, as are the rows of cells

    def leaves(piece: pa.Table) -> pa.Table:
        return piece.append_column("_leaf", pa.array(_leaves(matrix(piece.column("_p"), np.float64, how.degrees), how.leaf)))

    pieces = in_cells.join(F.broadcast(cells.select("_cell", "_pieces")), "_cell").select("_cell", F.pmod(F.xxhash64("_id"), "_pieces").cast("int").alias("_piece"), "_id", "_x", "_p")
    rows = materialise(pieces.groupBy("_cell", "_piece").applyInArrow(leaves, "_cell int, _piece int, _id long, _x array<double>, _p array<double>, _leaf int"), "index")
    edges = [matrix(boxes.column(n), np.float64, how.degrees) for n in ("_low", "_high")]
    return Index(rows, cells.select("_cell", "_pieces"), column(boxes, "_cell", np.int32), *edges, peak, width, how)


def _visits(index: Index, asked: DataFrame, k: int, reach: float, label: str) -> DataFrame:
    """asked: _query, _qx, _qp, _cell, _floor -> the best of each visited piece: _query, _found, _score."""
    asked = materialise(asked, label)
    blocks = asked.groupBy("_cell").agg(F.ceil(F.count("*") / index.how.queries).cast("int").alias("_blocks"))
    plan = F.broadcast(index.cells.join(blocks, "_cell"))  # how.cells rows at most
    upto = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    left = asked.join(plan, "_cell").withColumn("_block", F.pmod(F.xxhash64("_query"), "_blocks").cast("int")).withColumn("_piece", upto("_pieces"))
    right = index.rows.join(plan, "_cell").withColumn("_block", upto("_blocks"))
    key = ("_cell", "_piece", "_block")
    met = left.select(*key, "_query", "_qx", "_qp", "_floor").groupBy(*key).cogroup(right.select(*[F.col(c).alias(c) for c in key], "_id", "_x", "_p", "_leaf").groupBy(*key))
    return met.applyInArrow(_searched(k, reach, index.peak, index.width, index.how.degrees), FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    near = Window.partitionBy("_query").orderBy(F.desc("_score"), "_found")
    return found.withColumn("_rank", F.row_number().over(near).cast("int")).where(F.col("_rank") <= k)


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """queries (_id, _x) -> _query, _rank, _found, _score: the k nearest found of each, but for the row of its own id."""
    reach, basis, width = chi_square_quantile(index.how.confidence, index.how.degrees), index.how.basis(index.width), index.width
    numbers, low, high, peak, degrees = index.numbers, index.low, index.high, index.peak, index.how.degrees

    def home(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        p = projected(matrix(batch.column(1), np.float64, width), None, basis)
        return {"_qp": lists(p), "_cell": pa.array(numbers[np.argmin(box_distance(p, low, high), axis=1)])}

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All cells but the first that the test still lets a query visit."""
        for batch in batches:
            for part in (batch.slice(s, 256) for s in range(0, batch.num_rows, 256)):
                x, p, floor = matrix(part.column(1), np.float64, width), matrix(part.column(2), np.float64, degrees), column(part, "_floor", np.float64)
                on = box_distance(p, low, high) <= (reach * (2 - 2 * floor / (np.linalg.norm(x, axis=1) * peak) + SLACK))[:, None]
                i, j = np.nonzero(on & (numbers != column(part, "_cell", np.int32)[:, None]))
                for s in range(0, len(i), 4096):
                    at = pa.array(i[s : s + 4096])
                    yield pa.RecordBatch.from_arrays([*[part.column(c).take(at) for c in range(3)], pa.array(numbers[j[s : s + 4096]]), part.column(4).take(at)], names=["_query", "_qx", "_qp", "_cell", "_floor"])

    schema = "_query long, _qx array<double>, _qp array<double>, _cell int"
    asked = materialise(queries.select(F.col("_id").alias("_query"), F.col("_x").alias("_qx")).mapInArrow(_mapped(home, ("_query", "_qx")), schema), "queries")
    near = materialise(_visits(index, asked.withColumn("_floor", F.lit(float("-inf"))), k, reach, "visits"), "near")
    floors = _first(near, k).where(F.col("_rank") == k).select("_query", F.col("_score").alias("_floor"))
    known = asked.join(floors, "_query", "left").select("_query", "_qx", "_qp", "_cell", F.coalesce("_floor", F.lit(float("-inf"))).alias("_floor"))
    far = _visits(index, known.mapInArrow(others, schema + ", _floor double"), k, reach, "more_visits")
    return _first(near.unionByName(far), k)


def nearest_neighbours(df: DataFrame, query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", how: Projection = Projection()) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (inner product in double precision) of the k nearest rows found for each row that query, over the id column, marks.

    Fewer than k rows where there are fewer candidates: then all of them. Ties go to the smaller id. Vectors
    that are null, zero or hold null or non-finite components take no part, nor do null ids, vectors
    of another length than most have (the larger length of ties), and vectors whose squared norm is no
    finite double. Rows that repeat an id count once, with the smallest of their vectors. An empty table gives no rows.
    Other columns of df, whatever their names, take no part.
    """
    vectors, width = usable(df, id_col, vector_col)
    index = build_index(vectors, width, how) if width else None
    if index is None:
        return df.sparkSession.createDataFrame([], RESULT)
    marked = vectors.withColumn(id_col, F.col("_id")).where(query).select("_id", "_x")
    found = search(index, marked, k)
    return found.select(F.col("_query").alias("query_id"), F.col("_rank").alias("rank"), F.col("_found").alias("vec_id"), F.col("_score").alias("score"))
