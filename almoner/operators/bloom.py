"""Bloom filters of a given size, built and merged as bitmaps in the JVM, probed in Arrow batches, and audited."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS, HASHES = 2_000_000, 7
#: Bits for each key of a filter that is sized by its keys, and the most bits such a filter may have.
BITS_A_KEY, MOST_BITS = 10, 512 << 20
_CHUNK = 32_768  # bits of one of Spark's bitmaps


@dataclass(frozen=True)
class Bloom:
    m: int
    k: int
    bits: bytes

    def rate(self, keys: int) -> float:
        """Expected share of false positives with so many keys."""
        return (1 - np.exp(-self.k * keys / self.m)) ** self.k


def bits_for(keys: int) -> int | None:
    """Bits of a filter of so many keys; None where it would be too large to send around."""
    bits = max(BITS, BITS_A_KEY * keys)
    return bits if bits <= MOST_BITS else None


def positions(key: Column, m: int = BITS, k: int = HASHES) -> Column:
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), F.lit(m)) for i in range(k)])


def bloom_build(df: DataFrame, key: str, m: int = BITS, k: int = HASHES) -> Bloom:
    """Tasks set bits in partial bitmaps, which are merged; at most m / 32768 rows come to the driver. NULL keys are left out."""
    at = df.filter(F.col(key).isNotNull()).select(F.explode(positions(F.col(key), m, k)).alias("at"))
    rows = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros(-(-(m + 1) // _CHUNK) * _CHUNK // 8, np.uint8)
    for r in rows:  # buckets count from 1 for positive values, and 0 is in bucket 0
        start = max(0, r.bucket - 1) * _CHUNK // 8 if r.bucket else 0
        out[start : start + len(r.bits)] |= np.frombuffer(bytes(r.bits), np.uint8)
    return Bloom(m, k, out.tobytes())


def bloom_merge(*blooms: Bloom) -> Bloom:
    """The union of filters of one shape."""
    if len({(b.m, b.k) for b in blooms}) != 1:
        raise ValueError("filters differ in size or hashes")
    bits = np.frombuffer(blooms[0].bits, np.uint8).copy()
    for b in blooms[1:]:
        bits |= np.frombuffer(b.bits, np.uint8)
    return Bloom(blooms[0].m, blooms[0].k, bits.tobytes())


def _bit(at: np.ndarray) -> np.ndarray:
    """Where Spark's bitmaps hold a value: buckets of 32768 from 1 on, bit 0 first."""
    return np.where(at == 0, 0, at - 1)


def bloom_probe(df: DataFrame, key: str, bloom: Bloom) -> Column:
    """A boolean column: false for keys certainly not in the filter, and for NULL."""
    held = df.sparkSession.sparkContext.broadcast(bloom.bits)

    def probe(at: pa.Array) -> pa.Array:
        bits = np.frombuffer(held.value, np.uint8)
        where = _bit(at.flatten().to_numpy())
        on = (bits[where >> 3] >> (where & 7).astype(np.uint8)) & 1
        return pa.array(on.reshape(len(at), -1).all(1) if len(at) else [], pa.bool_())

    found = F.arrow_udf(probe, "boolean")(positions(F.col(key), bloom.m, bloom.k))
    return F.col(key).isNotNull() & found


def bloom_audit(df: DataFrame, key: str, predicate: Column, bloom: Bloom) -> DataFrame:
    """Keys that the filter and the predicate judge differently, as (cls, key); FALSE_NEGATIVE must not occur."""
    rows = df.withColumn("__in", bloom_probe(df, key, bloom)).withColumn("__is", F.coalesce(predicate, F.lit(False)))
    cls = F.when(F.col("__in") & ~F.col("__is"), "FALSE_POSITIVE").when(~F.col("__in") & F.col("__is"), "FALSE_NEGATIVE")
    return rows.select(cls.alias("cls"), F.col(key).alias("key")).filter(F.col("cls").isNotNull())


def bloom_save(spark: SparkSession, bloom: Bloom, path: str) -> None:
    spark.createDataFrame([(bloom.m, bloom.k, bytearray(bloom.bits))], "m int, k int, bits binary").coalesce(1).write.parquet(path)


def bloom_load(spark: SparkSession, path: str) -> Bloom:
    r = spark.read.parquet(path).first()
    return Bloom(r.m, r.k, bytes(r.bits))
