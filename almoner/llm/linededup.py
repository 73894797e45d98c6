"""Line deduplication over levelled sorted runs of line hashes.

Documents come in batches.  A batch's lines are summed up as, for each 128-bit hash of a line's key, the number of its
documents that hold it and the largest of their ids, bucketed and sorted by hash.  The batch is merge-anti-joined with
the runs of all batches before it: hashes that no run has become a run of their own, so that runs never share a hash; the
others go to a second set of runs, of repeats, with their counts.  When a level has ``FANOUT`` runs they are merged into
one of the next level.  At the end each run is merge-joined with the repeats, which gives every hash's number of documents
and largest id: a line whose key is in too many documents goes, except in the largest id that holds it.  Runs have one
bucketing, so that none of these joins and merges shuffles.

Defined results: a null or empty text is one empty line; a key is the line stripped of ASCII white space with A-Z
lower-cased, and keys of fewer than ``MIN_CHARS`` code points always stay; a line repeated within a document counts as
one document but each copy goes; rows that repeat a doc_id are one document and share its drops; a null id is below all
others; extra columns of any name pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import atexit
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almoner.llm.common import blobs, col, free, scratch_path, slices, small, tidy, written

MIN_CHARS, MIN_DOCS = 40, 5
BATCHES, FANOUT = 4, 2

HASH, COUNTS = ["h1", "h2"], ["n_docs", "max_doc"]

_SPACE = b" \t\n\x0b\x0c\r"


def key(line: bytes) -> bytes:
    """Stripped of ASCII white space, A-Z lower-cased."""
    return line.strip(_SPACE).lower()


def _chars(k: bytes) -> int:
    return len(k) if k.isascii() else len(k.decode("utf-8", "replace"))


def _digest(k: bytes) -> bytes:
    return hashlib.blake2b(k, digest_size=16).digest()


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows (doc_id, h1, h2): the distinct keys of each document that are long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b, texts in slices(whole, 1):
                found, owner = [], []
                for i, t in zip(b.column(0).to_pylist(), texts, strict=True):
                    own = {k for line in t.split(b"\n") if len(line) >= min_chars and _chars(k := key(line)) >= min_chars}
                    found += map(_digest, own)
                    owner += [i] * len(own)
                h = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
                yield pa.record_batch([pa.array(owner, pa.int64()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=["doc_id", "h1", "h2"])
        tidy()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, h1 long, h2 long")


class Runs:
    """Levels of runs (h1, h2, n_docs, max_doc) in the shared folder, all bucketed alike and sorted by hash.

    ``fresh`` runs hold each hash once, with what its first batch knows of it; ``repeats`` what later batches know.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.fresh: list[list[DataFrame]] = [[]]
        self.repeats: list[list[DataFrame]] = [[]]
        self.tables: list[str] = []
        atexit.register(self.close)

    def _run(self, rows: DataFrame) -> DataFrame:
        name = f"almoner_run_{uuid.uuid4().hex}"
        self.tables.append(name)
        rows.select(*HASH, *COUNTS).write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", scratch_path(self.spark, "line-run")).option("compression", "zstd").saveAsTable(name)
        return self.spark.table(name)

    def close(self) -> None:
        """Forget the runs' names; their files go when the driver ends."""
        while self.tables and self.spark.sparkContext._jsc is not None:
            self.spark.sql(f"drop table if exists {self.tables.pop()}")

    @staticmethod
    def _with(rows: DataFrame, run: DataFrame, how: str) -> DataFrame:
        """A merge join of ``rows`` with a run, whose counts are named n and m."""
        return rows.join(run.select(*HASH, F.col("n_docs").alias("n"), F.col("max_doc").alias("m")).hint("merge"), HASH, how)

    @classmethod
    def _summed(cls, rows: DataFrame, run: DataFrame, how: str) -> DataFrame:
        total = (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_docs")
        return cls._with(rows, run, how).select(*HASH, total, F.greatest("max_doc", "m").alias("max_doc"))

    def _merged(self, runs: list[DataFrame]) -> DataFrame | None:
        whole = runs[0] if runs else None
        for r in runs[1:]:
            whole = self._run(self._summed(whole, r, "full_outer"))
        return whole

    def _compact(self, levels: list[list[DataFrame]]) -> None:
        for depth, level in enumerate(levels):
            if len(level) >= self.fanout:
                if depth + 1 == len(levels):
                    levels.append([])
                levels[depth + 1].append(self._merged(level))
                level.clear()

    def add(self, lines: DataFrame) -> None:
        """Add the distinct (doc_id, h1, h2) of a batch whose documents no other batch holds."""
        self._compact(self.fresh)
        self._compact(self.repeats)
        batch = self._run(lines.groupBy(*HASH).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc")))
        new = batch
        known = [r for level in self.fresh for r in level]
        for r in known:
            new = self._with(new, r, "left_anti")
        if known:
            new = self._run(new)
            self.repeats[0].append(self._run(self._with(batch, new, "left_anti")))
        self.fresh[0].append(new)

    def repeated(self, min_docs: int) -> DataFrame:
        """Keys in at least ``min_docs`` documents, with the largest id."""
        repeats = self._merged([r for level in self.repeats for r in level])
        rows = None
        for r in (r for level in self.fresh for r in level):
            own = (r if repeats is None else self._summed(r, repeats, "left")).filter(F.col("n_docs") >= min_docs)
            rows = own if rows is None else rows.unionByName(own)
        return rows


def drops(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """Rows (doc_id, drop): for each document that loses lines, the hashes of their keys, 16 bytes each in one value."""
    hashed = line_hashes(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    lines = written(hashed, "lines", partition_by="batch")
    runs = Runs(docs.sparkSession, fanout)
    for b in range(batches):
        # rows that repeat an id lie in one batch; only such rows can repeat (id, hash)
        runs.add(lines.filter(F.col("batch") == b).select("doc_id", *HASH).dropDuplicates())
    repeated = written(runs.repeated(min_docs), "repeated-lines")
    runs.close()
    hit = lines.join(small(repeated.select(*HASH, "max_doc")), HASH).filter(~F.col("doc_id").eqNullSafe(F.col("max_doc")))
    # a document's list is no longer than the document
    return written(hit.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("drop")), "line-drops")


def _cut(text: bytes, drop: set[tuple[int, int]], min_chars: int) -> tuple[int, int, bytes]:
    lines = text.split(b"\n")
    if not drop:
        return len(lines), 0, text
    kept = [x for x in lines if len(x) < min_chars or _chars(k := key(x)) < min_chars or tuple(np.frombuffer(_digest(k), "<i8").tolist()) not in drop]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def _joined(docs: DataFrame, **options: int) -> tuple[DataFrame, str]:
    """``docs`` with one more column, the drops, and its name."""
    own, name = free(docs, "__id", "__drop")
    d = drops(docs, **options).select(F.col("doc_id").alias(own), F.col("drop").alias(name))
    # one plan at every size: the list of drops grows with the corpus, so it is never broadcast
    return docs.join(d.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col(own)), "left").drop(own), name


def _sets(column: pa.Array) -> list[set[tuple[int, int]]]:
    return [{(x["h1"], x["h2"]) for x in v} if v else set() for v in column.to_pylist()]


def dedup_report(docs: DataFrame, **options: int) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every document."""
    min_chars = options.get("min_chars", MIN_CHARS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b, texts in slices(whole, 1):
                rows = [_cut(t, s, min_chars) for t, s in zip(texts, _sets(b.column(2)), strict=True)]
                yield pa.record_batch([b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    rows, name = _joined(docs, **options)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"), name).mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def dedup_lines(docs: DataFrame, **options: int) -> DataFrame:
    """``docs`` with the repeated lines taken out of their texts; all rows and columns stay, null texts stay null."""
    min_chars = options.get("min_chars", MIN_CHARS)

    def run(texts: pa.Array, drop: pa.Array) -> pa.Array:
        return pa.array([_cut(t, s, min_chars)[2].decode() for t, s in zip(blobs(texts), _sets(drop), strict=True)], pa.string())

    text = F.col("text").cast("string")
    rows, name = _joined(docs, **options)
    cut = F.arrow_udf(run, "string")(text, F.col(name))
    # rows without drops go round the Python worker's result but not its input; both are batches, not groups
    kept = F.when(F.col(name).isNull(), text).otherwise(cut).alias("text")
    return rows.select(*[kept if c == "text" else col(c) for c in docs.columns])


ORACLE = r"""
WITH l AS (
  SELECT doc_id, pos, ls[pos] AS line,
         translate(regexp_replace(ls[pos], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
h AS (SELECT key, max(doc_id) AS max_doc FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, h.key IS NOT NULL AND l.doc_id <> h.max_doc AS dropped FROM l LEFT JOIN h ON l.key = h.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
