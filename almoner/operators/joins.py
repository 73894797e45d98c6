"""Joins of donations with projects under a choice of strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almoner import schemas
from almoner.functions.expressions import record, subject_contains, text_or_null, two_decimals
from almoner.operators.bloom import Bloom, bits_for, bloom_build, bloom_probe
from almoner.plans.session import BROADCAST_ROWS, broadcast_if_small

HOW = {"inner": "inner", "left": "left_outer", "right": "right_outer", "full": "full_outer"}
STRATEGIES = ("auto", "merge", "shuffle_hash", "broadcast", "salted")


def with_subject(projects: DataFrame, word: str | None) -> DataFrame:
    return projects if word is None else projects.filter(subject_contains(F.col("primary_focus_subject"), word))


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key that with the largest ``order``, for build sides that must be unique."""
    names = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("__row")).select(key, *[F.col("__row")[c].alias(c) for c in names])


def join_donations_projects(
    donations: DataFrame,
    projects: DataFrame,
    how: str = "inner",
    strategy: str = "auto",
    subject: str | None = None,
    min_total: float | None = None,
    bloom: Bloom | bool | None = None,
    recheck: bool = True,
    salts: int = 16,
    broadcast_rows: int = BROADCAST_ROWS,
    last_by_column: str | None = None,
) -> DataFrame:
    """Equi-join on project_id of five donation and four project columns, and whether each side is there.

    ``subject`` keeps projects whose subject holds the word; ``min_total`` keeps donations from that total on.  ``bloom``
    (a filter of project ids, or True to build it from the kept projects) thins out the donations, or, with
    ``recheck=False``, takes the subject test's place with its false positives.  ``broadcast`` is a request: the projects
    are counted, and over ``broadcast_rows`` the join shuffles.  ``salted`` deals each key over ``salts`` parts of the
    donations and copies the projects to each, for inner and left joins with keys that hold much of the data; the copies
    are merge-joined, never broadcast, as Spark's estimate of a side's size leaves copies out.  "" keys match each other.
    With ``last_by_column`` only the project of its largest value counts, of those with one id.  A filter built here is
    sized by its keys; for more keys than can be sent around none is built, as the join is exact without.
    """
    if how not in HOW or strategy not in STRATEGIES:
        raise ValueError(f"how is one of {list(HOW)}, strategy one of {STRATEGIES}")
    if bloom and how != "inner":
        raise ValueError("a Bloom filter may only thin out an inner join")
    if last_by_column:
        projects = last_by(projects.select(*schemas.PROJECT_PROJECTION, last_by_column), "project_id", last_by_column)
    p = projects.select(schemas.PROJECT_PROJECTION) if bloom and not recheck else with_subject(projects.select(schemas.PROJECT_PROJECTION), subject)
    d = donations.select(schemas.DONATION_PROJECTION)
    if min_total is not None:
        d = d.filter(F.col("total") >= min_total)
    if bloom is True:
        kept = with_subject(projects, subject)
        bits = bits_for(kept.count())
        if not bits and not recheck:
            raise ValueError("too many projects for an approximate join")
        bloom = bloom_build(kept, "project_id", bits) if bits else None
    if bloom:
        b = bloom
        d = d.filter(bloom_probe(d, "project_id", b))
        if not recheck:
            p = p.filter(bloom_probe(p, "project_id", b))
    d, p = d.withColumn("has_donation", F.lit(True)), p.withColumn("has_project", F.lit(True))
    on = ["project_id"]
    if strategy == "broadcast":
        if how not in ("inner", "left"):
            raise ValueError("only an inner or left join can broadcast the projects")
        p = broadcast_if_small(p, broadcast_rows)
    elif strategy == "merge":
        p = p.hint("merge")
    elif strategy == "shuffle_hash":
        p = p.hint("shuffle_hash")
    elif strategy == "salted":
        if how not in ("inner", "left"):
            raise ValueError("only an inner or left join can be salted")
        d = d.withColumn("__salt", F.pmod(F.xxhash64("donation_id"), F.lit(salts)).cast("int"))
        p = p.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
        on = ["project_id", "__salt"]
    joined = d.join(p, on, HOW[how])
    left, right = [c for c in schemas.DONATION_PROJECTION if c != "project_id"], [c for c in schemas.PROJECT_PROJECTION if c != "project_id"]
    there = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return joined.select("project_id", *left, *right, there("has_donation"), there("has_project"))


def format_join_records(df: DataFrame, order: str = "city_date") -> DataFrame:
    """(left, right) pipe records; the left one's third and fourth fields by ``order``; a missing side is all ``null``."""
    if order not in ("city_date", "date_city"):
        raise ValueError("order is city_date or date_city")
    third, fourth = ("donor_city", "ddate") if order == "city_date" else ("ddate", "donor_city")
    left = record([text_or_null(F.col(c)) for c in ("donation_id", "project_id", third, fourth)] + [two_decimals(F.col("total"))], F.col("has_donation"))
    right = record([text_or_null(F.col(c)) for c in ("project_id", "school_city", "poverty_level", "primary_focus_subject")], F.col("has_project"))
    return df.select(left.alias("left"), right.alias("right"))
