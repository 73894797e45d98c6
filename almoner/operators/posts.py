"""Per-user posts: rows (username, creation, content), creation a timestamp or a version-1 UUID."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almoner.functions.expressions import uuid1_timestamp


def _time(posts: DataFrame) -> Column:
    """Textual UUID order is not time order: sort by the time in it."""
    return uuid1_timestamp(F.col("creation")) if dict(posts.dtypes)["creation"] == "string" else F.col("creation")


def posts_count(posts: DataFrame) -> DataFrame:
    return posts.agg(F.count(F.lit(1)).alias("n"))


def user_posts(posts: DataFrame, user: str, n: int = 100, latest: bool = False) -> DataFrame:
    """The user's ``n`` oldest posts, or with ``latest`` the newest; ties by creation."""
    t = _time(posts)
    order = [t.desc(), F.col("creation").desc()] if latest else [t, F.col("creation")]
    return posts.filter(F.col("username") == user).orderBy(*order).limit(n)


def user_posts_with_date(posts: DataFrame, user: str, n: int | None = None) -> DataFrame:
    """The user's posts, newest first, with creation_date; all of them unless ``n`` is given."""
    rows = posts.filter(F.col("username") == user).withColumn("creation_date", F.date_trunc("millisecond", _time(posts))).orderBy(F.desc("creation_date"), F.desc("creation"))
    return rows if n is None else rows.limit(n)
