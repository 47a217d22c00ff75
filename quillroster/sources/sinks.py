"""Tables as plain Parquet and JSON folders: buckets of a table that are rewritten alone, and versions of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table; its writer chooses as many as leave a bucket some hundred MB, and it keeps them.
BUCKETS = 64


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    """The bucket of a row; a null key has one, too."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def put_buckets(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Write the buckets that df has rows of, in place of what they held; the others stay as they are.

    Tasks write beside the table and the driver swaps the buckets at the end, so that a lost executor
    costs its tasks. Large buckets are split over tasks. A bucket that df has no row of isn't emptied. df may be made of
    the table itself: what it reads stays until all tasks have written.
    """
    rows = df.drop("bucket").withColumn("bucket", bucket_of(key, buckets))
    rows.hint("rebalance", "bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def buckets_at(spark: SparkSession, path: str, schema: str, only: list[int] | None = None) -> DataFrame:
    """A table that put_buckets has written, with its bucket column; only: the buckets to be read, by pruning folders."""
    rows = spark.read.schema(f"{schema}, bucket int").parquet(path)
    return rows if only is None else rows.where(F.col("bucket").isin(only))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def add_version(df: DataFrame, path: str, version: int) -> None:
    """Write a document table as JSON under its version number; a version that a dead run left behind is replaced, the others stay."""
    df.withColumn("version", F.lit(version)).write.partitionBy("version").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)


def at_version(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """A version of a document table, the last one if none is named: earlier ones are its backups."""
    rows = spark.read.schema(f"{schema}, version int").json(path)
    if version is None:
        version = rows.agg(F.max("version")).first()[0]  # one row
    return rows.where(F.col("version") == version).drop("version")
