"""An extra beyond batch: word counts over a stream of text files, by the same tokeniser."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almoner.functions.expressions import tokens
from almoner.operators.words import MAX_LENGTH, word_count


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path)


def stream_word_count(lines: DataFrame, mode: str = "clean") -> DataFrame:
    """Running counts (output mode update or complete)."""
    return word_count(lines, mode)


def windowed_word_count(lines: DataFrame, time: str, window: str = "5 minutes", late: str = "10 minutes", mode: str = "clean") -> DataFrame:
    """Counts by event-time window of lines (value, ``time``); rows later than ``late`` are dropped."""
    timed = lines.withWatermark(time, late).select(F.col(time).alias("at"), F.explode(tokens(F.col("value"), mode)).alias("word"))
    return timed.filter(F.length("word") < MAX_LENGTH).groupBy(F.window("at", window), "word").agg(F.count(F.lit(1)).alias("count"))
