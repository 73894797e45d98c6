"""Sinks: columnar tables, key TAB value text, tuple lines, one file of counts, appended posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, compression: str = "zstd", mode: str = "error") -> None:
    df.write.mode(mode).option("compression", compression).parquet(path)


def sized(df: DataFrame, files: int | None) -> DataFrame:
    """None: as it is (0 reducers); else that many files, without a shuffle where there are more partitions already."""
    return df if files is None else df.coalesce(files)


def write_kv_text(df: DataFrame, path: str, key: str, value: str, files: int | None = None) -> None:
    line = F.concat_ws("\t", F.col(key).cast("string"), F.col(value).cast("string"))
    sized(df.select(line.alias("value")), files).write.text(path)


def write_tuples(counts: DataFrame, path: str) -> None:
    """Lines ``(word,count)``."""
    counts.select(F.format_string("(%s,%d)", "word", "count").alias("value")).write.text(path)


def write_counts_file(counts: DataFrame, path: str, ordered: bool = False) -> None:
    """``word count`` lines in one file."""
    rows = counts.orderBy("word") if ordered else counts
    rows.select(F.concat_ws(" ", "word", F.col("count").cast("string")).alias("value")).coalesce(1).write.text(path)


def append_posts(posts: DataFrame, path: str) -> None:
    posts.select("username", "creation", "content").write.mode("append").parquet(path)


def to_pandas(df: DataFrame, limit: int):
    """A bounded result for plotting."""
    return df.limit(limit).toPandas()
