"""Mixing sources to target weights by hash-threshold histograms; DataFrame functions only.

Each source gets a share of a word budget by weight; a share stops at ``max_repeat`` times the source's own words and
the excess is shared again (water-filling, in one sorted pass over the source table).  A document is taken ``copies``
times: the whole part of target / source size, plus one more if the hash of its id lies below the source's threshold.
Thresholds come from histograms: words summed by source and leading hash bits give the bucket in which the budget runs
out, and only that bucket is refined by further bits until it holds one hash.  Nothing is sorted, and a budget's
selection contains that of every smaller budget.

Defined results: a null text, like an empty one, has size 0; sources are weighed in code-point order, null last and a
source of its own; a source without words has target 0; equal ids have equal hashes and share their fate; a null id
hashes as the empty text; repeated rows each count; ``take`` returns
exactly the columns of its input, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almoner.llm.common import col, free, small, written

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
HASH_BITS, LEVEL_BITS = 60, 12
WORD = r"[^\x20\x09-\x0D]+"


def size(text: str | Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(doc_id: str | Column) -> Column:
    """The leading 60 bits of the MD5 of the id as text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, total: int | None = None) -> DataFrame:
    """From rows (source, size): source, source_size, target. The windows run over one row per source."""
    every = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    alone = Window.partitionBy()
    cap = F.col("source_size") * max_repeat
    budget = F.sum("source_size").over(alone) if total is None else F.least(F.lit(total).cast("long"), F.sum("source_size").over(alone) * max_repeat)
    return (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(every))
        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int")))
        .withColumn("budget", budget)
        .withColumn("ratio", cap / F.col("weight"))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum(cap).over(before), F.lit(0))) / (F.sum("weight").over(alone) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
        .withColumn("at", F.row_number().over(by_ratio))
        .withColumn("first", F.min(F.when(F.col("ratio") >= F.col("level"), F.col("at"))).over(alone))
        .withColumn("share", F.max(F.when(F.col("at") == F.col("first"), F.col("level"))).over(alone))
        .select("source", "source_size", F.when(F.col("first").isNull() | (F.col("at") < F.col("first")), cap.cast("double")).otherwise(F.col("share") * F.col("weight")).alias("target"))
    )


def thresholds(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with copies for all of a source (full) and the hash under which a document gets one more (threshold).

    ``sized`` has rows (source, size, hash).  A level's histogram has one row per source and bucket; after the first
    level only the bucket in which a source's budget runs out is read on.
    """
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = plan.withColumn("full", full).withColumn("left", F.col("target") - F.col("full") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long"))
    done, bits = [], 0
    while bits < HASH_BITS:
        bits += LEVEL_BITS
        within = sized.join(small(state.select(F.col("source").alias("s"), "prefix", "left")), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("hash", HASH_BITS - bits + LEVEL_BITS) == F.col("prefix")))
        histogram = within.groupBy("s", "left", F.shiftright("hash", HASH_BITS - bits).alias("bucket")).agg(F.sum("size").alias("n"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
        before = F.sum("n").over(Window.partitionBy("s").orderBy("bucket")) - F.col("n")
        edge = histogram.withColumn("before", before).filter((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("n")))
        edge = edge.select(F.col("s").alias("e"), F.col("bucket"), F.col("n"), "lo", "hi", (F.col("left") - F.col("before")).alias("rest"))
        joined = written(state.join(edge, F.col("source").eqNullSafe(F.col("e")), "left"), "mix-level")
        # settled: no bucket holds the edge (nothing to cut), or the bucket is a single hash, taken if that is nearer
        settled = F.col("bucket").isNull() | (F.col("lo") == F.col("hi"))
        cut = F.when(F.col("bucket").isNull(), F.lit(1 << HASH_BITS)).when(F.col("rest") * 2 >= F.col("n"), F.col("hi") + 1).otherwise(F.col("lo"))
        names = ["source", "source_size", "target", "full"]
        done.append(joined.filter(settled).select(*names, cut.alias("threshold")))
        state = joined.filter(~settled).select(*names, F.col("rest").alias("left"), F.col("bucket").alias("prefix"))
        if state.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The sized documents (doc_id, source, size, hash), written once, and the thresholds of their sources."""
    sized = written(docs.select("doc_id", F.col("source").cast("string").alias("source"), size(F.col("text").cast("string")).alias("size"), hash60("doc_id").alias("hash")), "mix-sizes")
    shares = written(targets(sized, weights, max_repeat, total), "mix-targets")
    return sized, thresholds(sized, shares)


def copies(rows: DataFrame, cuts: DataFrame, hashed: Column) -> tuple[DataFrame, dict[str, Column]]:
    """``rows`` joined with their sources' cuts, and source_size, target and copies over that; ``cuts`` is broadcast if it is small, else the join shuffles."""
    source, size, target, full, threshold, at = free(rows, "__source", "__size", "__target", "__full", "__threshold", "__hash")
    c = small(cuts.select(F.col("source").alias(source), F.col("source_size").alias(size), F.col("target").alias(target), F.col("full").alias(full), F.col("threshold").alias(threshold)))
    joined = rows.withColumn(at, hashed).join(c, F.col("source").cast("string").eqNullSafe(F.col(source)))
    return joined, {"source_size": F.col(size), "target": F.col(target), "copies": F.col(full) + F.when(F.col(at) < F.col(threshold), 1).otherwise(0)}


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    sized, cuts = plan(docs, **options)
    rows, of = copies(sized, cuts, F.col("hash"))
    return rows.select("doc_id", "size", of["source_size"].alias("source_size"), of["target"].alias("target"), (F.col("size") * of["copies"]).alias("taken"))


def take(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with the columns of ``docs``."""
    _, cuts = plan(docs, **options)
    rows, of = copies(docs, cuts, hash60("doc_id"))
    (copy,) = free(rows, "__copy")
    return rows.filter(of["copies"] > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), of["copies"]))).select(*map(col, docs.columns))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM s),
r AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, sum(source_size) OVER () AS budget FROM w),
q AS (SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS ratio FROM r),
l AS (
  SELECT *, row_number() OVER (ORDER BY ratio, place) AS ord,
         CAST(budget - coalesce(sum(3 * source_size) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM q),
f AS (SELECT *, min(CASE WHEN ratio >= level THEN ord END) OVER () AS first FROM l),
t AS (
  SELECT source, source_size,
         CASE WHEN first IS NULL OR ord < first THEN CAST(3 * source_size AS DOUBLE)
              ELSE max(CASE WHEN ord = first THEN level END) OVER () * weight END AS target
  FROM f),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS "full" FROM t),
k AS (SELECT source, h, sum(size) AS n FROM d GROUP BY source, h),
c AS (SELECT source, h, n, coalesce(sum(n) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT d.doc_id, d.size, b.source_size, b.target,
       CAST(d.size * (b."full" + CASE
         WHEN c.before + c.n <= b.target - b."full" * b.source_size THEN 1
         WHEN c.before <= b.target - b."full" * b.source_size AND (b.target - b."full" * b.source_size - c.before) * 2 >= c.n THEN 1
         ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h
"""
