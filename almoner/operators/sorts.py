"""Sorts: by sum, secondary, globally range-partitioned; ranks, shuffles and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almoner.functions.expressions import is_empty
from almoner.plans.session import ensure_checkpoint_dir, shuffle_partitions


def order_by_sum_desc(sums: DataFrame) -> DataFrame:
    """(total_sum, city), largest first; ties by city."""
    return sums.select("total_sum", "city").orderBy(F.desc("total_sum"), "city")


def swap_key_value(pairs: DataFrame) -> DataFrame:
    """key/value text to (total_sum float, city); a value that is no number fails."""
    return pairs.select(F.col("value").cast("float").alias("total_sum"), F.col("key").alias("city"))


def with_place(donations: DataFrame) -> DataFrame:
    """Rows that name both state and city; a blank counts as a name."""
    return donations.filter(~is_empty(F.col("donor_state")) & ~is_empty(F.col("donor_city")))


def composite_order(total: str = "desc") -> list[Column]:
    """State and city without case, then the total; ``asc`` is the composite key's natural order."""
    last = F.col("total").desc() if total == "desc" else F.col("total").asc()
    return [F.lower("donor_state"), F.lower("donor_city"), last]


def total_sort(df: DataFrame, keys: list[str | Column], partitions: int | None = None) -> DataFrame:
    """Range partitions, by default the session's number, sorted within and ordered among themselves; Spark samples the bounds."""
    return df.repartitionByRange(partitions or shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)


def natural_key_partitions(donations: DataFrame, partitions: int) -> DataFrame:
    """Hash partitions by state without case, each in composite order."""
    return donations.repartition(partitions, F.lower("donor_state")).sortWithinPartitions(*composite_order())


def secondary_sort(donations: DataFrame, partitions: int | None = None) -> DataFrame:
    """donation_id and "state city total", in composite order; ties by id."""
    keys = [*composite_order(), F.col("donation_id")]
    rows = with_place(donations)
    ordered = rows.orderBy(*keys) if partitions is None else total_sort(rows, keys, partitions)
    return ordered.select("donation_id", F.format_string("%s %s %.2f", "donor_state", "donor_city", F.col("total").cast("double")).alias("label"))


def global_rank(df: DataFrame, keys: list[Column], partitions: int | None = None, name: str = "rank") -> DataFrame:
    """``df`` with each row's place in the global order, without bringing all rows to one task.

    The sorted partitions are checkpointed, so that the ranks and the offsets come from the same partitions; a partition's
    offset is the count of rows before it, from a table of one row per partition.
    """
    ensure_checkpoint_dir(df.sparkSession)
    at, within = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    rows = total_sort(df, keys, partitions).withColumn("__id", F.monotonically_increasing_id()).checkpoint()
    counts = {r.p: r.n for r in rows.groupBy(at.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, before = [], 0
    for p in sorted(counts):
        offsets.append((p, before))
        before += counts[p]
    table = df.sparkSession.createDataFrame(offsets, "__p long, __before long")
    return rows.join(F.broadcast(table), at == F.col("__p")).withColumn(name, F.col("__before") + within + 1).drop("__p", "__before", "__id")


def random_shuffle(donations: DataFrame, partitions: int = 2, seed: int | None = None) -> DataFrame:
    """(state, city) of rows that name both, in random order; no row is lost or added."""
    return with_place(donations).select(F.col("donor_state").alias("state"), F.col("donor_city").alias("city")).repartition(partitions, F.rand(seed))


def sample_keys(donations: DataFrame, n: int, read_limit: int | None = None, seed: int | None = None) -> DataFrame:
    """``n`` random (state, city, total) of rows that name a place, from the first ``read_limit`` of them if given."""
    rows = with_place(donations).select(F.col("donor_state").alias("state"), F.col("donor_city").alias("city"), "total")
    return (rows if read_limit is None else rows.limit(read_limit)).orderBy(F.rand(seed)).limit(n)


