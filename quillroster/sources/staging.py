"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset and all runs in one JVM (tests), a local folder of this session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quillroster.staging.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="quillroster-")
        spark.conf.set("quillroster.staging.dir", folder)
        _forget_at_exit(spark, folder)
    return folder.rstrip("/")


def _forget_at_exit(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses; it goes with the session."""
    path = f"{shared_folder(spark)}/quillroster/{label}-{uuid.uuid4().hex}"
    _forget_at_exit(spark, path)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """df, written once as Parquet and read back, so that what is built on it neither plans nor computes it again."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt out to as many tasks as a shuffle has: what is made of a small table's rows is large, and its file may be read by one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
