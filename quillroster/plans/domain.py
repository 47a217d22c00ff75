"""The driver's tables seen as registrations: orders as events, line items as entries, suppliers as people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillroster.sources.readers import table


def tournaments(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("starts_at"), F.col("o_totalprice").alias("price_rub"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).alias("archived_at"), F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "team").otherwise("personal").alias("tournament_type"), F.col("o_orderpriority").alias("title"), F.col("o_custkey").alias("organizer_id"))


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """(l_orderkey, l_linenumber) isn't unique: rows that repeat an event and person stay apart only by place."""
    e = table(spark, folder, "lineitem")
    return e.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("tournament_id"), F.col("l_suppkey").alias("player_id"), F.when(F.col("l_linestatus") == "F", "paid").otherwise("pending").alias("payment_status"), (F.col("l_returnflag") != "R").alias("active"), F.col("l_shipdate").alias("created_at"), F.col("l_linenumber").alias("place"), F.col("l_extendedprice").alias("amount"))


def players(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("full_name"), F.col("s_nationkey").alias("nation_id"), F.col("s_acctbal").alias("balance"))


def part_names(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct part names as people; the smallest key is the id."""
    p = table(spark, folder, "part")
    return p.groupBy(F.col("p_name").alias("full_name")).agg(F.min("p_partkey").alias("id")).select("id", "full_name", F.lower("full_name").alias("normalized_name"))
