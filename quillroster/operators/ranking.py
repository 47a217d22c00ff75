"""Positions of rows within groups, without a window over a group: for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillroster.sources.staging import staged


def ranked(df: DataFrame, group: str | None, order: list[Column], label: str = "ranked") -> DataFrame:
    """df and _pos, the row's place in its group from 0 by order, and _total, the group's number of rows.

    The rows are dealt out by ranges of (group, order) and sorted within them, so that a group of any
    size is spread over tasks; a row's number within its task, less that of its group's first row there,
    plus the group's rows in the tasks before, is its place. Only one row for each group and task, with
    a count, meets in a window. Null is a group, and comes first. Rows that tie in order come in any
    order, the same one for all readers: the result is staged.
    """
    group_col = F.lit(0) if group is None else F.col(group)
    sort = [group_col.asc_nulls_first(), *order] if group is not None else order
    dealt = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    placed = staged(dealt.select("*", F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().alias("_at"), F.hash(group_col.isNull(), group_col).alias("_slot")), label)
    key = F.lit(0).alias("_key") if group is None else group_col.alias("_key")
    parts = placed.groupBy(key, "_task", "_slot").agg(F.min("_at").alias("_part_first"), F.count("*").alias("_part_rows"))
    before = Window.partitionBy("_key").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_key", F.col("_task").alias("_ptask"), F.col("_slot").alias("_pslot"), "_part_first", F.coalesce(F.sum("_part_rows").over(before), F.lit(0)).alias("_part_before"), F.sum("_part_rows").over(Window.partitionBy("_key")).alias("_total"))
    same = F.lit(True) if group is None else group_col.eqNullSafe(F.col("_key"))
    # _slot spreads the groups of one task over the join's tasks; it doesn't stand for the group.
    joined = placed.join(parts, (F.col("_task") == F.col("_ptask")) & (F.col("_slot") == F.col("_pslot")) & same)
    return joined.select(*df.columns, (F.col("_part_before") + F.col("_at") - F.col("_part_first")).alias("_pos"), "_total")
