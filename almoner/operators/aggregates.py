"""Grouped sums and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_teachers(donations: DataFrame) -> DataFrame:
    """Only the flag "t" excludes a row; "" and NULL stay."""
    return donations.filter(~F.col("donor_is_teacher").eqNullSafe("t"))


def sum_by_city(donations: DataFrame) -> DataFrame:
    """Totals of non-teachers by upper-case city; "" is a city. Summed as decimals, so the order of rows is no matter."""
    sums = without_teachers(donations).groupBy(F.upper("donor_city").alias("city")).agg(F.sum(F.col("total").cast("decimal(18,2)")).alias("s"))
    return sums.select("city", F.col("s").cast("double").alias("total_sum"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def top_per_group(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """An extra: the first ``n`` rows of each group. The rank filter lets Spark cut each group before the shuffle."""
    from pyspark.sql import Window

    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= n)
