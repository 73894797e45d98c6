"""Word counts and their top list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almoner.functions.expressions import tokens

MAX_LENGTH = 50


def words(lines: DataFrame, mode: str = "java") -> DataFrame:
    """One row per token shorter than MAX_LENGTH."""
    return lines.select(F.explode(tokens(F.col("value"), mode)).alias("word")).filter(F.length("word") < MAX_LENGTH)


def word_count(lines: DataFrame, mode: str = "java") -> DataFrame:
    return words(lines, mode).groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def top_words(counts: DataFrame, min_len: int = 3, min_count: int = 100_000, n: int = 30) -> DataFrame:
    """The most frequent long words, in SQL; ties by word."""
    return counts.sparkSession.sql(
        "select * from {counts} where length(word) >= :len and count > :least order by count desc, word limit :n",
        args={"len": min_len, "least": min_count, "n": n},
        counts=counts,
    )
