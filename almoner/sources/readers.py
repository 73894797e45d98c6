"""Sources: lenient CSV, key/value text, lines, column tables, and views over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almoner import schemas
from almoner.functions import expressions as E


@dataclass
class Ingest:
    """Parsed rows, the raw lines that were too short, and one row of counters (processed includes headers)."""

    rows: DataFrame
    rejects: DataFrame
    metrics: DataFrame


def _typed(part, kind: str):
    return E.float_or_zero(part) if kind == "float" else E.strict_int(part) if kind == "int" else part


def parse_lines(lines: DataFrame, fields: list[tuple[str, int, str]], width: int) -> DataFrame:
    """Rows of the fields from a column ``value``; lines of fewer than ``width`` parts are left out, further parts ignored."""
    parts = lines.select(E.csv_parts(F.col("value")).alias("p")).filter(F.size("p") >= width)
    return parts.select(*[_typed(F.col("p")[i], kind).alias(name) for name, i, kind in fields])


def parse_donations(lines: DataFrame) -> DataFrame:
    return parse_lines(lines, schemas.DONATION_FIELDS, schemas.DONATION_RAW_COLUMNS)


def parse_projects(lines: DataFrame) -> DataFrame:
    return parse_lines(lines, schemas.PROJECT_FIELDS, schemas.PROJECT_RAW_COLUMNS)


def _read_csv(spark: SparkSession, path: str, fields: list[tuple[str, int, str]], width: int) -> Ingest:
    raw = spark.read.text(path)
    first = raw.first()
    body = raw.filter(F.col("value") != first.value) if first else raw
    short = F.size(E.csv_parts(F.col("value"))) < width
    metrics = raw.agg(F.count(F.lit(1)).alias("processed"), F.count(F.when((F.col("value") != (first.value if first else "")) & short, 1)).alias("errors"))
    return Ingest(parse_lines(body, fields, width), body.filter(short), metrics)


def read_donations_csv(spark: SparkSession, path: str) -> Ingest:
    """A physical line is a record; the first line, wherever a file of the path repeats it, is the header."""
    return _read_csv(spark, path, schemas.DONATION_FIELDS, schemas.DONATION_RAW_COLUMNS)


def read_projects_csv(spark: SparkSession, path: str) -> Ingest:
    return _read_csv(spark, path, schemas.PROJECT_FIELDS, schemas.PROJECT_RAW_COLUMNS)


def key_values(lines: DataFrame) -> DataFrame:
    """The first TAB parts key and value; without one the value is ""."""
    p = F.split("value", "\t", 2)
    return lines.select(p[0].alias("key"), F.coalesce(F.get(p, F.lit(1)), F.lit("")).alias("value"))


def read_kv_text(spark: SparkSession, path: str) -> DataFrame:
    return key_values(spark.read.text(path))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A columnar table written by ``sinks.write_table``."""
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def describe_donations(donations: DataFrame) -> DataFrame:
    """One display line per donation."""
    return donations.select(F.format_string("%s|project=%s|city=%s|total=%.2f", "donation_id", "project_id", "donor_city", F.col("total").cast("double")).alias("value"))


def describe_projects(projects: DataFrame) -> DataFrame:
    return projects.select(F.format_string("%s|school=%s|total_amount=%s|status=%s", "project_id", "school_id", F.col("total_price_including_opt_donation").cast("string"), "funding_status").alias("value"))


def compat_view(donations: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The 17-column view, columns bound by position to ``names`` if given; another number of names is an error."""
    view = donations.select(schemas.COMPAT_COLUMNS)
    return _renamed(view, names)


def projects_view(projects: DataFrame, names: list[str] | None = None) -> DataFrame:
    return _renamed(projects.select([n for n, _, _ in schemas.PROJECT_FIELDS]), names)


def _renamed(view: DataFrame, names: list[str] | None) -> DataFrame:
    if names is None:
        return view
    if len(names) != len(view.columns):
        raise ValueError(f"{len(names)} names for {len(view.columns)} columns")
    return view.toDF(*names)


def register_views(spark: SparkSession, donations: DataFrame, projects: DataFrame) -> None:
    """Temporary views donations, projects and donations_compat; they are read-only."""
    donations.createOrReplaceTempView("donations")
    projects.createOrReplaceTempView("projects")
    compat_view(donations).createOrReplaceTempView("donations_compat")
