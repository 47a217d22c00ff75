"""What several operators share: shared-folder tables, text preparation, row keys, bounded loops."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space that separates words and is squeezed by normalisation.
SPACE = r"\x20\x09-\x0D"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir as the cluster sets it.

    Only where it is unset and the session runs in one JVM (tests) is a local folder chosen, once
    per session; elsewhere an unset folder is an error, as no machine-local folder would do.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quillroster.shared.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="quillroster-")
        _forget_at_exit(spark, folder)
        spark.conf.set("quillroster.shared.dir", folder)
    return folder.rstrip("/")


def _forget_at_exit(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def new_table_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; it is removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/quillroster/{label}-{uuid.uuid4().hex}"
    _forget_at_exit(spark, path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts lineage (a lost executor costs a re-read, not a recomputation), fixes values that
    depend on partition numbers, and gives later joins a size that they can plan with.
    """
    path = new_table_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def squeezed(text: Column) -> Column:
    """Each run of white space becomes one space; single spaces, the usual case, aren't matched at all."""
    return F.regexp_replace(text, rf"[\x09-\x0D][{SPACE}]*|\x20[{SPACE}]+", " ")


def lowest(share: float) -> int:
    """The 64-bit hash up to which lies that share of all hashes: as exact for one row in 10^11 as for one in two."""
    return max(-(1 << 63), int(min(1.0, share) * 2**64) - (1 << 63) - 1)


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality over the keys, for join(); both sides name them alike."""
    return reduce(Column.__and__, [left[k].eqNullSafe(right[k]) for k in keys])


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on null-safe equality of the keys and keep the left side's copy of them."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = reduce(Column.__and__, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def keep_one(df: DataFrame, stay: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of df that stay names, one of those that repeat a key, all columns kept.

    keys: stay's key columns and what they stand for in df; stay's _k_m says how many rows have the
    key. Rows that repeat one are few next to the table: only they are grouped.
    """
    on = reduce(Column.__and__, [made.eqNullSafe(F.col(k)) for k, made in keys.items()])
    once = df.join(stay.where("_k_m = 1"), on, "left_semi")
    again = df.join(stay.where("_k_m > 1"), on).dropDuplicates(list(keys)).select(*df.columns)
    return once.unionByName(again)
