"""Hard negatives by a two-dimensional block matrix multiplication (SUMMA's scheme as Spark shuffles).

The score matrix, anchors by rows, is cut into tiles, and the dimensions into chunks. A task gets one
block of anchors and one of rows, both for one chunk, and multiplies them: a partial tile of 64-bit
integers. The partial tiles of a tile meet in a shuffle and are added. Of each whole tile an anchor's
row keeps its scores and its best positives; the best of all tiles are the anchor's positives. Each of
them opens a window of scores, of which every tile row gives its first negatives, and these are reduced
to the first of all tiles. Blocks are dealt by hashes of ids, so that no label, id or score makes a
large one, and a group in memory is one tile's blocks of bounded size, whatever the table has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillroster.llm.common import materialise
from quillroster.llm.vectors import column, commonest_length, finite, matrix

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
PARTIAL = "_i int, _j int, _c int, _anchors binary, _anchor_labels binary, _ids binary, _labels binary, _tile binary"
TILE_ROW = "anchor_id long, anchor_label long, _ids binary, _labels binary, _scores binary, _best array<struct<score: long, id: long>>"
MINED = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


@dataclass(frozen=True)
class Mining:
    """How many positives an anchor has and negatives each of them; the window low * positive <= 100 * negative <= high * positive.

    Components are floor(scale * x). A tile has about `anchors` by `rows` scores; a vector has chunks of
    `chunk` dimensions, or longer ones so that there are `chunks` at most to be added.
    """

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    scale: int = 256
    anchors: int = 256
    rows: int = 512
    chunk: int = 32
    chunks: int = 8


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in 64-bit integers; by floating point where all sums are exact in it."""
    most = lambda x: int(np.abs(x).max(initial=0))
    if most(a) * most(b) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _multiplied(left: pa.Table, right: pa.Table) -> pa.Table:
    """One partial tile, anchors and rows by id; the first chunk's also says whose it is."""
    schema = pa.schema([(n, pa.int32()) for n in ("_i", "_j", "_c")] + [(n, pa.binary()) for n in ("_anchors", "_anchor_labels", "_ids", "_labels", "_tile")])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    width, (c, i, j) = len(left.column("_part")[0]), (left.column(k)[0].as_py() for k in ("_c", "_i", "_j"))
    order = [np.argsort(column(t, "_row")) for t in (left, right)]
    parts = [matrix(t.column("_part"), np.int64, width)[o] for t, o in zip((left, right), order)]
    whose = [column(t, name)[o].tobytes() if c == 0 else None for t, o in zip((left, right), order) for name in ("_row", "_of")]
    return pa.Table.from_pylist([dict(zip(schema.names, (i, j, c, *whose, _product(*parts).tobytes())))], schema)


def _added(positives: int) -> Callable[[pa.Table], pa.Table]:
    """Adds the partial tiles of a tile, and picks the best positives that it has for each anchor."""

    def added(tile: pa.Table) -> pa.Table:
        total = np.frombuffer(tile.column("_tile")[0].as_py(), np.int64).copy()
        for k in range(1, tile.num_rows):
            total += np.frombuffer(tile.column("_tile")[k].as_py(), np.int64)
        first = tile.filter(pc.equal(tile.column("_c"), 0))
        whose = {n: first.column(n)[0].as_py() for n in ("_anchors", "_anchor_labels", "_ids", "_labels")}
        anchors, anchor_labels, ids, labels = (np.frombuffer(b, np.int64) for b in whose.values())
        scores, out = total.reshape(len(anchors), len(ids)), []
        for row, anchor, label in zip(scores, anchors.tolist(), anchor_labels.tolist()):
            same = np.flatnonzero((labels == label) & (ids != anchor))
            best = same[np.argsort(-row[same], kind="stable")[:positives]]  # ids ascend: ties go to the smaller
            out.append((anchor, label, whose["_ids"], whose["_labels"], row.tobytes(), [{"score": s, "id": x} for s, x in zip(row[best].tolist(), ids[best].tolist())]))
        pair = pa.struct([("score", pa.int64()), ("id", pa.int64())])
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pair)]
        names = ["anchor_id", "anchor_label", "_ids", "_labels", "_scores", "_best"]
        return pa.table([pa.array(list(values), kind) for values, kind in zip(zip(*out), kinds)], names)

    return added


def _windowed(how: Mining) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A tile row beside its anchor's positives -> for each of them the first negatives of its window that this tile row has."""

    def windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for k in range(batch.num_rows):
                anchor, label, positives = (batch.column(n)[k].as_py() for n in ("anchor_id", "anchor_label", "_positives"))
                ids, labels, scores = (np.frombuffer(batch.column(n)[k].as_py(), np.int64) for n in ("_ids", "_labels", "_scores"))
                least, most = min(how.low * p["score"] for p in positives), max(how.high * p["score"] for p in positives)
                at = np.flatnonzero((labels != label) & (100 * scores >= least) & (100 * scores <= most))
                at = at[np.argsort(-scores[at], kind="stable")]
                hundredfold = 100 * scores[at]
                for p in positives:
                    start, end = np.searchsorted(-hundredfold, -how.high * p["score"]), np.searchsorted(-hundredfold, -how.low * p["score"], side="right")
                    for x in at[start : max(start, min(end, start + how.negatives))].tolist():
                        for values, v in zip(out, (anchor, p["id"], p["score"], int(ids[x]), int(scores[x]))):
                            values.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return windowed


def hard_negatives(df: DataFrame, anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", how: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for the rows that anchor marks.

    label: an integer for each row. Rows with a null id, label or vector, or with a null or non-finite
    component, take no part, nor do vectors of another length than most have (the larger length of
    ties). Rows that repeat an id count once: the one with the smallest label and then vector. An
    anchor's positives are its best other rows of its label; ties go to the smaller id. Anchors without
    positives, and positives with no row of another label in their window, give no rows; an empty
    table gives none. Components so large that 64-bit sums of their products could overflow raise
    ValueError. Other columns of df, whatever their names, take no part.
    """
    spark = df.sparkSession
    whole = F.transform(vector_col, lambda x: x.cast("double"))
    fit = df.where(F.col(id_col).isNotNull() & label.isNotNull() & finite(vector_col))
    fit = fit.select(F.col(id_col).cast("long").alias("_id"), label.cast("long").alias("_label"), whole.alias("_x"), F.coalesce(anchor, F.lit(False)).alias("_anchor"))
    width = commonest_length(fit, "_x")
    if not width:
        return spark.createDataFrame([], RESULT)
    one = fit.where(F.size("_x") == width).groupBy("_id").agg(F.min(F.struct("_label", "_x", "_anchor")).alias("_row"))
    kept = materialise(one.select("_id", "_row.*"), "vectors")
    n, asked, peak = kept.agg(F.count("*"), F.count_if("_anchor"), F.max(F.array_max(F.transform("_x", F.abs)))).first()
    bound = float(peak) * how.scale + 1
    if bound * bound * width * max(100, how.high) >= 2**62:
        raise ValueError("components are too large for 64-bit scores")
    if not asked:
        return spark.createDataFrame([], RESULT)

    down, across = -(-asked // how.anchors), -(-n // how.rows)
    chunk = max(how.chunk, -(-width // how.chunks))
    ints = F.transform("_x", lambda x: F.floor(x * how.scale).cast("long"))
    cut = F.expr(f"transform(sequence(0, {-(-width // chunk) - 1}), c -> slice(_ints, c * {chunk} + 1, {chunk}))")
    block = lambda seed, blocks: F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    cells = lambda rows: rows.select(F.col("_id").alias("_row"), F.col("_label").alias("_of"), "_i", "_j", F.posexplode(cut).alias("_c", "_part")).groupBy("_i", "_j", "_c")
    whole_rows = kept.withColumn("_ints", ints)
    left = whole_rows.where("_anchor").withColumn("_i", block(1, down)).withColumn("_j", every(across))
    right = whole_rows.withColumn("_j", block(2, across)).withColumn("_i", every(down))
    partial = cells(left).cogroup(cells(right)).applyInArrow(_multiplied, PARTIAL)
    tiles = materialise(partial.groupBy("_i", "_j").applyInArrow(_added(how.positives), TILE_ROW), "tiles")

    first = lambda keys, score, name: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), name))
    best = tiles.select("anchor_id", F.explode("_best").alias("_b")).select("anchor_id", "_b.*").withColumn("_rank", first(["anchor_id"], "score", "id")).where(F.col("_rank") <= how.positives)
    positives = materialise(best.groupBy("anchor_id").agg(F.collect_list(F.struct("score", "id")).alias("_positives")), "positives")
    mined = tiles.select("anchor_id", "anchor_label", "_ids", "_labels", "_scores").join(positives, "anchor_id").mapInArrow(_windowed(how), MINED)
    ranked = mined.withColumn("rank", first(["anchor_id", "positive_id"], "negative_score", "negative_id").cast("int")).where(F.col("rank") <= how.negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
