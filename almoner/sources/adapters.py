"""Star-schema tables seen as donations, projects, posts and lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almoner.plans.session import broadcast_if_small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def donations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its supplier's nation as city and region as state; ids join all four key columns.

    Suppliers are counted and broadcast if few: Spark multiplies the sizes of what they are joined with, and would shuffle lineitem first.
    """
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")
    flag = lambda c: F.when(c, "t").otherwise("f")
    rows = table(spark, sf_dir, "lineitem").join(broadcast_if_small(s), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("donation_id"),
        F.col("l_partkey").cast("string").alias("project_id"),
        F.col("n_name").alias("donor_city"),
        F.col("r_name").alias("donor_state"),
        flag(F.col("l_returnflag") == "R").alias("donor_is_teacher"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("ddate"),
        F.col("l_quantity").alias("amount"),
        F.col("l_discount").alias("support"),
        F.col("l_extendedprice").alias("total"),
        F.col("l_linestatus").alias("payment_method"),
        flag(F.col("l_linenumber") == 1).alias("payment_inc_acct_credit"),
        flag(F.col("l_linenumber") == 2).alias("payment_inc_campaign_gift_card"),
        flag(F.col("l_linenumber") == 3).alias("payment_inc_web_gift_card"),
        flag(F.col("l_linenumber") == 4).alias("payment_promo_matched"),
        flag(F.col("l_linenumber") == 5).alias("via_giving_page"),
        flag(F.col("l_linenumber") == 6).alias("for_honoree"),
        flag(F.col("l_linenumber") == 7).alias("thank_you_packet"),
        F.col("l_returnflag").alias("message"),
    )


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as the join's projection of projects."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("project_id"), F.col("p_brand").alias("school_city"), F.col("p_type").alias("poverty_level"), F.col("p_name").alias("primary_focus_subject"), "p_size")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("username"), F.col("ts").alias("creation"), F.col("props").alias("content"))


def uuid_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with creation as a version-1 UUID of that time."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(creation as timestamp_ntz))")
    ticks = F.lpad(F.lower(F.hex(micros * 10 + F.lit(122192928000000000))), 15, "0")
    name = F.concat(F.substring(ticks, 8, 8), F.lit("-"), F.substring(ticks, 4, 4), F.lit("-1"), F.substring(ticks, 1, 3), F.lit("-8000-"), F.lpad(F.hex(F.crc32("content")), 12, "0"))
    return posts(spark, sf_dir).select("username", F.lower(name).alias("creation"), "content")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The physical lines of all document texts."""
    return table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n", -1)).alias("value"))
