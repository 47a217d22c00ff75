"""Tables of vectors: which rows take part, and Arrow lists as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """Neither the vector nor a component is null, NaN or infinite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(fine, F.lit(False))


def commonest_length(df: DataFrame, vector: str) -> int | None:
    """The length that most vectors have, the larger one of ties; None for an empty table."""
    found = df.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return found and found["size"]


def matrix(column: pa.ChunkedArray | pa.Array, dtype: type, width: int) -> np.ndarray:
    """A list column, all lists of that width, as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), width)


def column(table: pa.Table, name: str, dtype: type = np.int64) -> np.ndarray:
    return table.column(name).to_numpy().astype(dtype, copy=False)


def lists(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as a list column."""
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1)))
