"""Embedding near-duplicates by iterative quantisation, multi-index Hamming tables and exact reranking.

Unit vectors are centred and turned by rotations that are learned on a bounded sample, so that the signs of the
coordinates are balanced binary codes that lose little of the vectors.  The codes, from several rotations, are cut into
short substrings, and each substring indexes one hash table.  Tables hold codes only: vectors that agree on a substring
are candidates if their whole codes lie within a Hamming radius, and original vectors are fetched for candidates alone
and reranked by cosine in double precision.

Length of the substrings, number of tables and the radius follow from the sample: its vectors are turned to exactly the
threshold in random directions, and the codes' differences give the tables that find ``RECALL`` of such pairs and the
radius that holds ``WITHIN`` of them.

Equal vectors are one node with a count.  A bucket is compared as a block: each pair is counted in the first table where
it meets, and a block puts out its candidates' rows, then one row per vector (its links) and one edge per vector (to its
group in the block), never its pairs.  A bucket of over ``BLOCK`` vectors is cut into blocks of pairs of chunks, which
any number of tasks share.

Defined results: vectors that are null, zero, of another length than most, or with null or non-finite components link
with nothing; rows that repeat a vec_id count as further copies; a null vec_id is its own component (null) and, as a
copy, counts; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almoner.llm.common import sampled, small, written
from almoner.llm.graph import connected

THRESHOLD = 0.9
RECALL = 0.97
#: Share of the pairs at the threshold that the Hamming radius must hold.
WITHIN = 0.999
FIT_ROWS = 5000
#: Pairs at the threshold that are drawn from the sample at least, to set tables and radius.
DRAWS = 2000
#: Tables at most: where vectors lie so close together that more were needed, substrings get shorter instead.
TABLES = 256
ROUNDS = 25
#: Vectors of a bucket that are compared in one block.
BLOCK = 1024


@dataclass
class Index:
    """The sample's mean, projections of all tables' bits (dimensions x tables*bits), and the Hamming radius of whole codes."""

    mean: np.ndarray
    planes: np.ndarray
    tables: int
    bits: int
    radius: int

    def on(self, x: np.ndarray) -> np.ndarray:
        """rows x bits: the whole codes of unit vectors."""
        return (x - self.mean) @ self.planes > 0

    def keys(self, x: np.ndarray) -> np.ndarray:
        """rows x tables substrings as integers; together they are the whole code."""
        return (self.on(x).reshape(len(x), self.tables, self.bits) << np.arange(self.bits)).sum(2).astype(np.int32)


def rotation(x: np.ndarray, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """Iterative quantisation: alternate the codes' signs and the orthogonal map that brings the vectors nearest to them."""
    rng = np.random.default_rng(seed)
    r = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
    for _ in range(rounds if len(x) else 0):
        u, _, vt = np.linalg.svd(x.T @ np.where(x @ r > 0, 1.0, -1.0))
        r = u @ vt
    return r


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def turned(x: np.ndarray, threshold: float, seed: int = 0) -> np.ndarray:
    """Unit vectors at a cosine of exactly ``threshold`` to those of ``x``, in random directions."""
    y = np.random.default_rng(seed).normal(size=x.shape)
    y = unit(y - (y * x).sum(1, keepdims=True) * x)
    return threshold * x + math.sqrt(1 - threshold**2) * y


def fit(sample: np.ndarray, rows: int, threshold: float = THRESHOLD, recall: float = RECALL) -> Index:
    """Learn an index for ``rows`` vectors: substrings of about log2(rows) - 4 bits, shorter if TABLES tables do not find enough."""
    dim, x = sample.shape[1], unit(sample)
    mean = x.mean(0) if len(x) else np.zeros(dim)
    planes = rotation(x - mean, 0)
    probe = np.resize(x, (max(len(x), DRAWS), dim)) if len(x) else np.zeros((0, dim))
    near = turned(probe, threshold)
    same = ((probe - mean) @ planes > 0) == ((near - mean) @ planes > 0)
    agree = min(max(float(same.mean()), 0.5), 1 - 1e-6) if len(x) and dim > 1 else 1 - math.acos(threshold) / math.pi
    bits = min(30, max(6, round(math.log2(max(rows, 2))) - 4))
    while True:
        tables = min(TABLES, max(4, math.ceil(math.log(1 - recall) / math.log(1 - agree**bits))))
        while True:
            need = bits * tables
            while planes.shape[1] < need:
                planes = np.concatenate([planes, rotation(x - mean, planes.shape[1] // dim)], 1)
            index = Index(mean, planes[:, :need], tables, bits, need)
            a, b = index.keys(probe), index.keys(near)
            found = float((a == b).any(1).mean()) if len(x) else 1.0
            if found >= recall or tables == TABLES:
                break
            tables = min(TABLES, math.ceil(tables * 1.25))
        if found >= recall or bits == 1:
            break
        bits -= 1
    if len(x):
        index.radius = math.ceil(np.quantile((index.on(probe) != index.on(near)).sum(1), WITHIN))
    return index


def _components(link: np.ndarray) -> np.ndarray:
    """Smallest row reachable, for each row of a symmetric boolean matrix."""
    n = len(link)
    label = np.arange(n)
    while True:
        near = np.where(link, label[None, :], n).min(1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _candidates(keys: np.ndarray, side: np.ndarray, table: int, radius: int, bits: int) -> np.ndarray:
    """Pairs of rows (i, j), i < j, within the Hamming radius that have met in no earlier table. side: 0 all with all, else 1 with 2."""
    sign = (((keys[:, :, None] >> np.arange(bits)) & 1) * 2 - 1).reshape(len(keys), -1).astype(np.float32)
    near = np.triu(sign @ sign.T >= sign.shape[1] - 2 * radius - 0.5, 1)
    if side.any():
        near &= side[:, None] != side[None, :]
    pairs = np.argwhere(near)
    if table:
        new = [~(keys[part[:, 0], :table] == keys[part[:, 1], :table]).any(1) for part in np.array_split(pairs, len(pairs) // 32_768 + 1)]
        pairs = pairs[np.concatenate(new)]
    return pairs


def _block(mult: np.ndarray, vec: np.ndarray, pairs: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row among the candidates, and the row that stands for its group."""
    n, link = len(mult), np.zeros((len(mult), len(mult)), bool)
    for at in range(0, len(pairs), 1 << 15):
        i, j = pairs[at : at + (1 << 15)].T
        on = np.einsum("ij,ij->i", vec[i], vec[j]) >= threshold
        link[i[on], j[on]] = link[j[on], i[on]] = True
    return (link @ mult, _components(link)) if link.any() else (np.zeros(n, np.int64), np.arange(n))


BLOCK_SCHEMA = "tab int, key int, lo int, hi int, side int, node long, mult long, keys binary"


def _by_block(rows: DataFrame, f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``f`` makes of each block of more than one row."""
    block, names = ["tab", "key", "lo", "hi"], [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([back, t]).combine_chunks() if back is not None else t
            code = np.stack([t[c].to_numpy() for c in block], 1)
            edge = [0, *(np.flatnonzero((code[1:] != code[:-1]).any(1)) + 1).tolist()]
            out = [f(t.slice(lo, hi - lo)).select(names) for lo, hi in zip(edge[:-1], edge[1:], strict=True) if hi - lo > 1]
            back = t.slice(edge[-1])
            if out:
                yield from pa.concat_tables(out).combine_chunks().to_batches()
        if back is not None and back.num_rows > 1:
            yield from f(back).select(names).combine_chunks().to_batches()

    return rows.repartition(*block).sortWithinPartitions(*block).mapInArrow(run, schema)


def usable(column: str, dim: int) -> F.Column:
    c = F.col(column)
    good = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(c, lambda x: x != 0)
    return F.coalesce((F.size(c) == dim) & good, F.lit(False))


def links(vectors: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    most = rows.filter(F.size("embedding") > 0).groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = most.dim if most else 1
    ok = usable("embedding", dim)
    alone = rows.filter(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    valid = rows.filter(ok)
    # equal vectors are one node; a group of null ids only has no id to stand for it and gets none
    nodes = written(valid.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult")).withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    n = nodes.count()
    rate = min(1.0, fit_rows / max(1, n))
    got = nodes.filter(sampled("embedding", rate)).select("embedding").toArrow()
    index = fit(np.array(got["embedding"].combine_chunks().flatten()).reshape(-1, dim), n, threshold)
    tables = index.tables
    held = vectors.sparkSession.sparkContext.broadcast(index)

    def units(column: pa.Array) -> np.ndarray:
        return unit(np.array(column.flatten()).reshape(-1, dim))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                keys = held.value.keys(units(part.column(2)))
                columns = [
                    pa.array(np.repeat(np.arange(tables, dtype=np.int32), len(keys))), pa.array(keys.T.ravel()),
                    pa.array(np.tile(part.column(0).to_numpy(), tables)), pa.array(np.tile(part.column(1).to_numpy(), tables)),
                    pa.array([v.tobytes() for v in keys] * tables, pa.binary()),
                ]
                yield pa.record_batch(columns, names=["tab", "key", "node", "mult", "keys"])

    members = nodes.select("node", "mult", "embedding").mapInArrow(spread, "tab int, key int, node long, mult long, keys binary")
    # only buckets of more than a block need cutting
    hot = written(members.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).select("tab", "key", F.ceil(F.col("n") / block).cast("int").alias("m")), "hot-buckets")
    cut = members.join(small(hot), ["tab", "key"], "left").withColumn("m", F.coalesce("m", F.lit(1))).withColumn("c", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    cut = cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    cut = cut.select("tab", "key", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"), F.when(F.col("m") == 1, 0).when(F.col("c") == F.col("o"), F.lit(0)).when(F.col("c") < F.col("o"), 1).otherwise(2).alias("side"), "node", "mult", "keys")

    def pairs_of(t: pa.Table) -> np.ndarray:
        keys = np.frombuffer(b"".join(t["keys"].to_pylist()), np.int32).reshape(t.num_rows, tables)
        return _candidates(keys, t["side"].to_numpy(), t["tab"][0].as_py(), held.value.radius, held.value.bits)

    def nominate(t: pa.Table) -> pa.Table:
        return t.take(pa.array(np.unique(pairs_of(t))))

    def rerank(t: pa.Table) -> pa.Table:
        node = t["node"].to_numpy()
        n, group = _block(t["mult"].to_numpy(), units(t["embedding"].combine_chunks()), pairs_of(t), threshold)
        hit = (n > 0) | (group != np.arange(len(node)))
        return pa.table({"node": node[hit], "n": n[hit].astype(np.int64), "to": node[group[hit]]})

    # codes decide which rows of a block have a candidate; only those fetch their vectors
    candidates = written(_by_block(cut, nominate, BLOCK_SCHEMA), "vector-candidates")
    vectors_of = candidates.join(nodes.select("node", "embedding"), "node")
    found = written(_by_block(vectors_of.select(*candidates.columns, "embedding"), rerank, "node long, n long, to long"), "vector-links")
    counts = found.groupBy("node").agg(F.sum("n").alias("linked"))
    named = nodes.select("node", "rep", "mult")
    reps = found.select("node", "to").filter("node <> to").dropDuplicates()
    # components are sought over the smallest ids themselves, so that a component's label is its smallest id
    edges = reps.join(named.select("node", F.col("rep").alias("a")), "node").join(named.select(F.col("node").alias("to"), F.col("rep").alias("b")), "to").select("a", "b").filter("a is not null and b is not null")
    labels = connected(edges)
    done = nodes.join(counts, "node", "left").join(labels, F.col("rep") == F.col("id"), "left")
    done = written(done.select("embedding", (F.coalesce("linked", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "vector-classes")
    linked = valid.join(done, "embedding").select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    return linked.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).unionByName(alone)
