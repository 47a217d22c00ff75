"""Changes to tables as pure functions: prior state and changes in, next state out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sub-groups in which new ids are counted, so that they need no single task.
ID_BUCKETS = 256


def _on(keys: list[str]) -> Column:
    """Equality with the keys of a frame renamed by _right."""
    return reduce(Column.__and__, [F.col(k) == F.col(f"_r_{k}") for k in keys])


def _right(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_r_{c}") for c in df.columns])


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last in the given order."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_last"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in df.columns])


def with_new_ids(df: DataFrame, prior: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """df with ids that follow prior's largest without gaps; equal inputs get equal ids.

    keys have to tell rows apart. Ranks are taken within hashed buckets and moved by the buckets'
    prefix sums, at most ID_BUCKETS rows, so that no task sees all rows.
    """
    rows = df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(ID_BUCKETS)).cast("int"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_bucket").agg(F.count("*").alias("_rows")).select("_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    most = prior.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_most"))  # one row
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys)))
    return ranked.join(F.broadcast(starts), "_bucket").crossJoin(F.broadcast(most)).withColumn(id_col, (F.col("_most") + F.col("_start") + F.col("_rank")).cast("long")).drop("_bucket", "_start", "_rank", "_most")


def update_keyed(prior: DataFrame, changes: DataFrame, keys: list[str], columns: list[str], guard: Column | None = None) -> DataFrame:
    """Rows whose key is in changes (once at most) get its columns, nulls too, if guard, over the prior row, is true."""
    joined = prior.join(_right(changes.select(*keys, *columns).withColumn("_hit", F.lit(True))), _on(keys), "left")
    hit = F.col("_r__hit").isNotNull()
    if guard is not None:
        hit = hit & F.coalesce(guard, F.lit(False))
    return joined.select(*[F.when(hit, F.col(f"_r_{c}")).otherwise(F.col(c)).cast(prior.schema[c].dataType).alias(c) if c in columns else F.col(c) for c in prior.columns])


def upsert(prior: DataFrame, incoming: DataFrame, keys: list[str], update: list[str], fill: list[str] | None = None) -> DataFrame:
    """Known keys take `update` columns from incoming, and `fill` columns where theirs is null; new keys are added whole.

    incoming has one row for each key; columns that it lacks are null in new rows.
    """
    fill = fill or []
    joined = prior.withColumn("_old", F.lit(True)).join(_right(incoming).withColumn("_new", F.lit(True)), _on(keys), "full_outer")
    out = []
    for c in prior.columns:
        theirs = F.col(f"_r_{c}") if c in incoming.columns else F.lit(None)
        known = theirs if c in update else F.coalesce(F.col(c), theirs) if c in fill else F.col(c)
        out.append(F.when(F.col("_old").isNull(), theirs).when(F.col("_new").isNull(), F.col(c)).otherwise(known).cast(prior.schema[c].dataType).alias(c))
    return joined.select(*out)


def insert_missing(prior: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """prior and the incoming rows whose key it lacks."""
    return prior.unionByName(incoming.join(prior.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True).select(*prior.columns)


def delete_keyed(prior: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return prior.join(gone.select(*keys).distinct(), keys, "left_anti").select(*prior.columns)


def soft_delete(prior: DataFrame, gone: DataFrame, keys: list[str], flag: str = "active") -> DataFrame:
    return update_keyed(prior, gone.select(*keys).distinct().withColumn(flag, F.lit(False)), keys, [flag])


def null_references(child: DataFrame, gone: DataFrame, column: str, gone_key: str = "id") -> DataFrame:
    """ON DELETE SET NULL."""
    lost = gone.select(F.col(gone_key).alias("_gone")).distinct()
    return child.join(lost, F.col(column) == F.col("_gone"), "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(*child.columns)


def cascade_delete(child: DataFrame, gone: DataFrame, column: str, gone_key: str = "id") -> DataFrame:
    """ON DELETE CASCADE."""
    return child.join(gone.select(F.col(gone_key).alias("_gone")).distinct(), F.col(column) == F.col("_gone"), "left_anti")


def expire(pending: DataFrame, run_id: Column) -> DataFrame:
    """Pending rows of other runs expire; those without a run stay, as the comparison is null."""
    old = (F.col("status") == "pending") & (F.col("sync_run_id") != run_id)
    return pending.withColumn("status", F.when(old, F.lit("expired")).otherwise(F.col("status")))
