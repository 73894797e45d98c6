"""Shared plumbing of the training-data operators: scratch tables, checked broadcasts, text batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side up to which it is broadcast; beyond it, callers shuffle.
BROADCAST_ROWS = 20_000
#: Bytes of text that a Python worker holds at once, besides the Arrow batch it came in.
CHUNK_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one of our own only where it is unset and all run in one place."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="almoner-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a scratch path through the file system that owns it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/almoner/{name}-{uuid.uuid4().hex}"

    def clean() -> None:
        if spark.sparkContext._jsc is not None:
            delete(spark, path)

    atexit.register(clean)
    return path


def written(df: DataFrame, name: str, **options: object) -> DataFrame:
    """``df`` cut from its lineage by a Parquet table in the shared folder."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if "partition_by" in options:
        writer = writer.partitionBy(options["partition_by"])
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(table: DataFrame, partition: str = "") -> None:
    """Remove a table that ``written`` made, or one partition of it, when nothing reads it any more."""
    delete(table.sparkSession, f"{table.scratch}/{partition}".rstrip("/"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is counted to hold at most ``rows`` rows, else as it is (the join then shuffles)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def col(name: str) -> Column:
    """The column of exactly this name, which may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def free(df: DataFrame, *stems: str) -> list[str]:
    """Names like ``stems`` that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bound(share: float) -> int:
    """What a 64-bit hash is at most, for about ``share`` of all values."""
    return min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))


def sampled(key: str | Column, share: float) -> Column:
    """True for about ``share`` of the keys, by their hash; all at 1."""
    return F.xxhash64(key) <= F.lit(bound(share)).cast("long")


def tidy() -> None:
    """Give a Python worker's freed memory back, as it lives on for other tasks and stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def fold_of(doc_id: int | None, parts: int) -> int:
    """The same in Python, for tests."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts


def blobs(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def chunks(values: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``values`` of about ``limit`` bytes, one value at least."""
    start = held = 0
    for i, v in enumerate(values):
        if held and held + len(v) > limit:
            yield start, i
            start, held = i, 0
        held += len(v) + 1
    if start < len(values):
        yield start, len(values)


def slices(batch: pa.RecordBatch, column: int, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batch in slices of about ``limit`` bytes of a string column, one row at least, each with that column's blobs."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64) + 1)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, "right")))
        part = batch.slice(start, stop - start)
        yield part, blobs(part.column(column))
        start = stop
