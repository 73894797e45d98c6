"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network with calibrated output.

Every token has a sparse random index vector, fixed by its hash; a word's vector is the sum of the index vectors of its
neighbours over the whole corpus.  Words live in ``SLOTS`` hashed slots, so the table has one size whatever the corpus.
A document is the mean and spread of its normalised word vectors and its log length.  A tanh network is trained on a
bounded sample of labelled rows (``FIT_ROWS``), and its logit is divided by a temperature fitted on rows held back from
that sample.

Defined results: a null or empty text has the zero document vector and gets that vector's score; with no usable labels
every score is 0.5; with labels of one kind the score is that kind's smoothed share; repeated rows stay; a document with
several labels counts once for each; extra columns are ignored.  Texts of any length are used whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almoner.llm.common import blobs, chunks, fold, sampled, written

SLOTS, DIM = 1 << 15, 32
WINDOW, NONZERO = 2, 2
ROWS_PER_BLOCK = 256
FIT_ROWS = 20_000
HIDDEN = 24
FEATURES = 2 * DIM + 1

_TOKEN = re.compile(rb"[a-z\x80-\xff]+|[0-9]+|[^\sa-z0-9\x80-\xff]")
_rng = np.random.default_rng(11)
#: Index vectors: for each slot the positions of its entries, and their signs.
PLACE = np.stack([_rng.permuted(np.tile(np.arange(DIM), (SLOTS, 1)), axis=1)[:, k] for k in range(NONZERO)], 1).astype(np.int32)
SIGN = _rng.choice([-1.0, 1.0], (SLOTS, NONZERO)).astype(np.float32)


def slots(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The slots of all tokens in a row, and where each text's begin (one entry more than texts)."""
    found = [_TOKEN.findall(t.lower()) for t in texts]
    flat = np.fromiter((crc32(w) for f in found for w in f), np.uint32, sum(map(len, found)))
    return (flat & (SLOTS - 1)).astype(np.int64), np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)


def contexts(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SLOTS x DIM: for each word the sum of its neighbours' index vectors, within texts."""
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at, by = [], []
    for gap in range(1, WINDOW + 1):
        same = doc[gap:] == doc[:-gap]
        left, right = ids[:-gap][same], ids[gap:][same]
        for word, near in ((left, right), (right, left)):
            for k in range(NONZERO):
                at.append(word * DIM + PLACE[near, k])
                by.append(SIGN[near, k])
    return np.bincount(np.concatenate(at), np.concatenate(by), SLOTS * DIM).reshape(SLOTS, DIM)


def _sums(blocks: DataFrame, tasks_at_once: int = 64) -> DataFrame:
    """Add float32 blocks of one key, first those of up to 64 tasks each, so that no group grows with the corpus."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, np.float32).astype(np.float64) for v in table["v"].to_pylist())
        return pa.table({"part": pa.array([table["part"][0].as_py() // tasks_at_once], pa.int64()), "block": table["block"].slice(0, 1).cast(pa.int32()), "v": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    first = blocks.groupBy("block", F.expr(f"part div {tasks_at_once}").alias("g")).applyInArrow(add, "part long, block int, v binary")
    return first.groupBy("block").applyInArrow(add, "part long, block int, v binary")


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit vectors of all slots, learned from every text."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((SLOTS, DIM))
        for b in batches:
            values = blobs(b.column(0))
            for lo, hi in chunks(values, 2 << 20):
                total += contexts(*slots(values[lo:hi]))
        blocks = [(i, total[i * ROWS_PER_BLOCK : (i + 1) * ROWS_PER_BLOCK]) for i in range(SLOTS // ROWS_PER_BLOCK)]
        blocks = [(i, v.astype(np.float32).tobytes()) for i, v in blocks if v.any()]
        part = TaskContext.get().partitionId()
        yield pa.record_batch([pa.array([part] * len(blocks), pa.int64()), pa.array([i for i, _ in blocks], pa.int32()), pa.array([v for _, v in blocks], pa.binary())], names=["part", "block", "v"])

    out = np.zeros((SLOTS, DIM), np.float32)
    for r in _sums(docs.select(F.col(text_col).cast("string")).mapInArrow(learn, "part long, block int, v binary")).collect():
        out[r.block * ROWS_PER_BLOCK : (r.block + 1) * ROWS_PER_BLOCK] = np.frombuffer(r.v, np.float32).reshape(-1, DIM)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


def pool_texts(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """documents x FEATURES."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for lo, hi in chunks(texts, 1 << 20):
        ids, starts = slots(texts[lo:hi])
        n = np.diff(starts)
        full = np.flatnonzero(n)
        if len(full):
            v = vectors[ids]
            mean = np.add.reduceat(v, starts[:-1][full], axis=0) / n[full, None]
            np.multiply(v, v, out=v)
            square = np.add.reduceat(v, starts[:-1][full], axis=0) / n[full, None]
            out[lo + full] = np.concatenate([mean, np.sqrt(np.maximum(square - mean**2, 0)), np.log1p(n[full, None])], 1)
    return out


def pooled(docs: DataFrame, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, v): document vectors as float32 bytes, written to the shared folder."""
    held = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = pool_texts(blobs(b.column(1)), held.value)
            yield pa.record_batch([b.column(0), pa.array([x.tobytes() for x in v], pa.binary())], names=["doc_id", "v"])

    return written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, v binary"), "pooled")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, steps: int = 600, rate: float = 0.01, decay: float = 1e-3) -> Model:
    """Full-batch Adam on log loss; every fifth row is held back for the temperature."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    share = (y.sum() + 1) / (len(y) + 2)
    rng = np.random.default_rng(5)
    m = Model(x.mean(0) if len(x) else np.zeros(FEATURES), x.std(0) + 1e-3 if len(x) else np.ones(FEATURES), rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share))))
    if len(y) < 10 or y.min() == y.max():
        return m
    back = np.arange(len(y)) % 5 == 4
    z, t = (x[~back] - m.mean) / m.scale, y[~back]
    m.w2 = rng.normal(0, HIDDEN**-0.5, HIDDEN)
    weights = [m.w1, m.b1, m.w2, np.array([m.b2])]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        h = np.tanh(z @ weights[0] + weights[1])
        d = (1 / (1 + np.exp(-(h @ weights[2] + weights[3][0]))) - t) / len(t)
        dh = np.outer(d, weights[2]) * (1 - h * h)
        for w, g, a, b in zip(weights, [z.T @ dh + decay * weights[0], dh.sum(0), h.T @ d + decay * weights[2], np.array([d.sum()])], first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    m.b2 = float(weights[3][0])
    logit, t = m.logits(x[back]), y[back]
    grid = np.exp(np.linspace(-1.5, 1.5, 61))
    m.temperature = float(grid[np.argmin([np.logaddexp(0, np.where(t == 1, -logit, logit) / g).mean() for g in grid])])
    return m


def fit(documents: DataFrame, labels: DataFrame, label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Learn from pooled documents whose crc32 fold of 5 is not 0; a larger label table is sampled by hash down to about ``fit_rows``."""
    known = labels.select(F.col("doc_id").cast("long"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).filter(fold("doc_id", 5) != 0)
    rate = min(1.0, fit_rows / max(1, known.count()))
    known = known.filter(sampled("doc_id", rate))
    got = documents.join(known, "doc_id").select(F.xxhash64("doc_id", F.lit(1)).alias("h"), "y", "v").toArrow()
    order = np.lexsort((np.array(got["y"].to_pylist(), np.int8), np.array(got["h"].to_pylist(), np.int64)))
    x = np.frombuffer(b"".join(got["v"].to_pylist()), np.float32).reshape(-1, FEATURES)
    return train(x[order], np.array(got["y"].to_pylist(), np.int64)[order])


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(-1, FEATURES)
            yield pa.record_batch([b.column(0), pa.array(model.scores(x), pa.float64())], names=["doc_id", "score"])

    return documents.select("doc_id", "v").mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    documents = pooled(docs, word_vectors(docs))
    return score(documents, fit(documents, labels)).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
