"""Near-duplicate documents by BagMinHash signatures of word-shingle multisets, banding and exact verification.

A document is the multiset of its ``SHINGLE``-word shingles.  For each shingle there are Poisson processes on a hierarchy
of weight intervals [0,1), [1,2), [2,4), [4,8) ...: a process' points fall on registers at random, and those of the
interval that the shingle's count ends in are kept where their own weight lies below the count.  A register holds its
smallest point, so two documents agree in a register with the probability of their weighted Jaccard similarity.
Processes run only as far as a bound under which all registers are filled with high probability; documents with one left
go on to twice that.

Documents of equal token sequences are one node.  Bands of registers propose links: first between each bucket's smallest
id and its members; then each node's best partners by signature in groups it has not joined; what is left, every pair of
different groups' members in a common bucket whose signatures allow the similarity, is verified inside blocks of the
bucket, each pair in the first band that it shares, and puts out links only.  Every link is verified by the exact multiset
Jaccard similarity, and classes are the components.  No step puts out a bucket's pairs, and no pair is left out because a
bucket is large.  Joins whose small side grows with the corpus are merge joins at any size.

Defined results: tokens are runs of bytes other than ASCII white space, A-Z lower-cased; a text of one to four words is
one shingle; a null or empty text, or one of white space, links with nothing; rows that repeat a doc_id are one document,
whose texts, if they differ, share a class; a null doc_id is below all others and never joins a class; extra columns pass through; an empty table gives an empty
result.  Texts of any length are used whole.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almoner.llm.common import blobs, col, free, slices, small, tidy, written
from almoner.llm.graph import connected, extended

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 6
REGISTERS = BANDS * ROWS
#: Share of equal registers under which a pair is not verified: 4.5 standard deviations below SIMILARITY.
LIKELY = 0.65
#: Documents of a bucket compared by signature in one block.
BLOCK = 512
#: Partners that a node proposes from a block before all that is left is verified.
BEST = 2
#: Ids up to which a list of them is broadcast.
IDS = 500_000

_U = np.uint64
_GOLDEN, _A, _B = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> _U(30))) * _A
    x = (x ^ (x >> _U(27))) * _B
    return x ^ (x >> _U(31))


def _times(n: int, by: np.uint64) -> np.uint64:
    return _U(n * int(by) & 0xFFFFFFFFFFFFFFFF)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


_HASHES = _Hashes()


def _done() -> None:
    """At a task's end: what it has cached goes, as its worker lives on."""
    _HASHES.clear()
    tidy()


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def shingles(tokens: list[bytes]) -> np.ndarray:
    """64-bit hashes of a document's shingles, sorted, with repeats."""
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))
    n = max(1, len(h) - SHINGLE + 1)
    out = np.full(n, len(h) if len(h) < SHINGLE else SHINGLE, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        out = _mix(out * _GOLDEN + h[k : k + n])
    out.sort()
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted multisets."""
    if not len(a) or not len(b):
        return 0.0
    (ua, ca), (ub, cb) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    both = np.minimum(ca[ia], cb[ib]).sum()
    return float(both / (len(a) + len(b) - both))


def signatures(bags: list[np.ndarray]) -> np.ndarray:
    """documents x REGISTERS: the smallest point of each register; infinite throughout for an empty bag."""
    out = np.full((len(bags), REGISTERS), np.inf)
    weights = np.array([len(b) for b in bags])
    todo, reach = np.flatnonzero(weights), np.log(REGISTERS) + 3
    while len(todo):
        bound = REGISTERS * reach / weights[todo]
        flat = np.concatenate([bags[i] for i in todo])
        doc = np.repeat(np.arange(len(todo)), weights[todo])
        first = np.concatenate([[True], (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])])
        at = np.flatnonzero(first)
        element, owner, count = flat[at], doc[at], np.diff(np.concatenate([at, [len(flat)]]))
        register = np.full(len(todo) * REGISTERS, np.inf)
        level = 0
        while len(element):
            low = 0 if level == 0 else 1 << (level - 1)  # the interval [low, low + width)
            width = 1 if level == 0 else low
            seed = _mix(element ^ _times(level + 1, _B))
            x, live, step = np.zeros(len(element)), np.arange(len(element)), 0
            while len(live):
                step += 1
                z = _mix(seed[live] + _times(step, _GOLDEN))
                x = x - np.log((np.float64(1.0) + (z >> _U(11))) * 2.0**-53) / width
                on = x <= bound[owner[live]]
                live, x, z = live[on], x[on], z[on]
                y = _mix(z ^ _A)
                slot = owner[live] * REGISTERS + ((y >> _U(32)) % _U(REGISTERS)).astype(np.int64)
                if level:
                    under = low + ((y & _U(0xFFFFFFFF)) % _U(width)).astype(np.int64) < count[live]
                    np.minimum.at(register, slot[under], x[under])
                else:
                    np.minimum.at(register, slot, x)
            level += 1
            more = count > (1 << (level - 1))
            element, owner, count = element[more], owner[more], count[more]
        got = register.reshape(-1, REGISTERS)
        full = np.isfinite(got).all(1)
        out[todo[full]] = got[full]
        todo, reach = todo[~full], reach * 2
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """documents x BANDS hashes of the registers' exact values."""
    bits = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bits.shape[:2]).copy()
    for k in range(ROWS):
        out = _mix(out * _GOLDEN + bits[:, :, k])
    return out.view(np.int64)


def short(signature: np.ndarray) -> np.ndarray:
    """One byte a register, to estimate similarity by."""
    return (_mix(signature.view(np.uint64)) >> _U(56)).astype(np.uint8)


def sketches(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, print, bands, sig): print is the digest of the token sequence, null without tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b, texts in slices(whole, 1, 1 << 20):
                tokens = [words(t) for t in texts]
                s = signatures([shingles(t) for t in tokens])
                prints = [hashlib.blake2b(b" ".join(t), digest_size=16).digest() if t else None for t in tokens]
                yield pa.record_batch(
                    [b.column(0), pa.array(prints, pa.binary()), pa.array([v.tobytes() for v in bands(s)], pa.binary()), pa.array([v.tobytes() for v in short(s)], pa.binary())],
                    names=["doc_id", "print", "bands", "sig"],
                )
        _done()

    return written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, print binary, bands binary, sig binary"), "sketches")


def _buckets(nodes: DataFrame) -> DataFrame:
    """Rows (band, key, node): each node under each of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64).reshape(-1, BANDS)
            yield pa.record_batch([pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(keys))), pa.array(keys.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], names=["band", "key", "node"])

    return nodes.select("node", "bands").mapInArrow(run, "band int, key long, node long")


def _mixed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one label: (band, key, lo, hi, second, node, label).

    A bucket of over BLOCK nodes is cut into blocks of pairs of chunks lo and hi; second marks the rows of chunk hi.
    """
    named = buckets.join(labels.hint("merge"), buckets.node == labels.id, "left").select("band", "key", "node", F.coalesce("component", "node").alias("label"))
    sizes = named.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("band", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("m"))
    rows = named.join(sizes.hint("merge"), ["band", "key"]).withColumn("c", F.pmod(F.xxhash64("node"), F.col("m")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    return written(rows.select("band", "key", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"), (F.col("c") > F.col("o")).alias("second"), "node", "label"), "mixed-buckets")


def _likely(t: pa.Table, new_only: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of a block the rows of other labels whose signatures allow the similarity, and the share of registers.

    ``new_only`` leaves out those with which the row shares an earlier band.
    """
    label, second = t["label"].to_numpy(), np.array(t["second"].to_pylist())
    sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(len(label), REGISTERS)
    if t["lo"][0].as_py() == t["hi"][0].as_py():
        second[:] = False
    across = bool(second.any())
    if new_only:
        band, keys = t["band"][0].as_py(), np.frombuffer(b"".join(t["bands"].to_pylist()), np.int64).reshape(len(label), BANDS)
    for i in range(len(label)):
        near = np.flatnonzero((label != label[i]) & (second != second[i]) if across else label != label[i])
        share = (sig[near] == sig[i]).mean(1)
        near, share = near[share >= LIKELY], share[share >= LIKELY]
        if new_only and len(near):
            new = ~(keys[near, :band] == keys[i, :band]).any(1)
            near, share = near[new], share[new]
        yield i, near, share


def _pair_table(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["a", "b"])


def _best(t: pa.Table) -> pa.Table:
    """Each row's likeliest partners."""
    node, out = t["node"].to_numpy(), set()
    for i, near, share in _likely(t):
        for j in near[np.argsort(-share, kind="stable")[:BEST]]:
            out.add((int(min(node[i], node[j])), int(max(node[i], node[j]))))
    return _pair_table(sorted(out))


def _with_partner(t: pa.Table) -> pa.Table:
    """The rows that have a pair to be verified in this block."""
    keep = np.zeros(t.num_rows, bool)
    for i, near, _ in _likely(t, new_only=True):
        keep[near] = True
        keep[i] |= len(near) > 0
    return t.filter(pa.array(keep))


def _links(t: pa.Table, similarity: float) -> pa.Table:
    """Links between the block's labels, likeliest first; labels that a link has joined need no other."""
    node = t["node"].to_numpy()
    texts, bags, out = blobs(t["text"].combine_chunks()), {}, []
    label = t["label"].to_pylist()
    root = {x: x for x in label}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def bag(i: int) -> np.ndarray:
        if i not in bags:
            bags[i] = shingles(words(texts[i]))
        return bags[i]

    found = []
    for i, near, share in _likely(t, new_only=True):
        on = near > i
        found += [(-s, i, j) for s, j in zip(share[on].tolist(), near[on].tolist(), strict=True)]
    for _, i, j in sorted(found):
        if find(label[i]) != find(label[j]) and min(len(bag(i)), len(bag(j))) >= similarity * max(len(bag(i)), len(bag(j))) and jaccard(bag(i), bag(j)) >= similarity:
            root[find(label[i])] = find(label[j])
            out.append((int(min(node[i], node[j])), int(max(node[i], node[j]))))
    return _pair_table(out)


def _by_block(rows: DataFrame, f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``f`` makes of each block of more than one row."""
    block, names = ["band", "key", "lo", "hi"], [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back: pa.Table | None = None

        def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
            if t.num_rows > 1:
                yield from f(t).select(names).to_batches()

        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([back, t]).combine_chunks() if back is not None else t
            code = np.stack([t[c].to_numpy().astype(np.int64) for c in block], 1)
            edge = [0, *(np.flatnonzero((code[1:] != code[:-1]).any(1)) + 1).tolist()]
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                yield from found(t.slice(lo, hi - lo))
            back = t.slice(edge[-1])
        if back is not None:
            yield from found(back)
        _done()

    return rows.repartition(*block).sortWithinPartitions(*block).mapInArrow(run, schema)


def _texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (node, text) of the documents that some pair names."""
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).dropDuplicates()
    return written(docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text")).join(small(ids, IDS), "node", "left_semi"), "pair-texts")


def verified(docs: DataFrame, pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose exact weighted Jaccard similarity is at least ``similarity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[int, np.ndarray] = OrderedDict()

        def bag(node: int, text: bytes) -> np.ndarray:
            if node not in recent:
                recent[node] = shingles(words(text))
                if len(recent) > 64:
                    recent.popitem(last=False)
            recent.move_to_end(node)
            return recent[node]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ta, tb = blobs(batch.column(2)), blobs(batch.column(3))
            ok = [jaccard(bag(i, s), bag(j, t)) >= similarity for i, j, s, t in zip(a, b, ta, tb, strict=True)]
            yield pa.record_batch([batch.column(0).filter(pa.array(ok, pa.bool_())), batch.column(1).filter(pa.array(ok, pa.bool_()))], names=["a", "b"])
        _done()

    texts = _texts(docs, pairs)
    left = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "ta"}).hint("merge"), "a")
    both = left.join(texts.withColumnsRenamed({"node": "b", "text": "tb"}).hint("merge"), "b")
    return written(both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"), "links")


PAIRS_SCHEMA = "a long, b long"
ROWS_SCHEMA = "band int, key long, lo int, hi int, second boolean, node long, label long, bands binary, sig binary"


def _same_id(known: DataFrame, prints: DataFrame) -> DataFrame:
    """Rows (a, b): the nodes of the texts that one doc_id has, where it has several."""
    several = known.groupBy("doc_id").agg(F.min("print").alias("x"), F.max("print").alias("y")).filter("x <> y").select("doc_id")
    nodes = known.join(several, "doc_id", "left_semi").join(prints, "print").select("doc_id", "node").dropDuplicates()
    return nodes.join(nodes.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b")).filter("a <> b").dropDuplicates()


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, kept for every row: the class' smallest doc_id, and whether the row is that document's."""
    sketch = sketches(docs)
    known = sketch.filter(F.col("print").isNotNull() & F.col("doc_id").isNotNull())
    prints = known.groupBy("print").agg(F.min("doc_id").alias("node"))
    nodes = written(prints.join(known.select(F.col("doc_id").alias("node"), "print", "bands", "sig"), ["node", "print"]).select("node", "print", "bands", "sig").dropDuplicates(["node", "print"]), "nodes")
    buckets = written(_buckets(nodes), "buckets")
    heads = buckets.groupBy("band", "key").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").drop("z")
    tested = written(buckets.join(heads.hint("merge"), ["band", "key"]).select("a", F.col("node").alias("b")).filter("a <> b").dropDuplicates(), "pairs")
    links = verified(docs, tested, similarity).unionByName(written(_same_id(known, nodes.select("print", "node")), "links"))
    labels = connected(links)
    mixed = _mixed(buckets, labels)
    near = _by_block(mixed.join(nodes.select("node", "sig").hint("merge"), "node"), _best, PAIRS_SCHEMA).filter("a <> b").dropDuplicates()
    labels = extended(labels, verified(docs, written(near.join(tested.hint("merge"), ["a", "b"], "left_anti"), "pairs"), similarity))
    # texts go only to the rows of blocks whose signatures call for them
    rest = _by_block(_mixed(buckets, labels).join(nodes.select("node", "sig", "bands").hint("merge"), "node"), _with_partner, ROWS_SCHEMA)
    rest = written(rest, "likely-rows")
    texts = _texts(docs, rest.select(F.col("node").alias("a"), F.col("node").alias("b")))
    found = _by_block(rest.join(texts.hint("merge"), "node"), lambda t: _links(t, similarity), PAIRS_SCHEMA)
    labels = extended(labels, written(found.filter("a <> b").dropDuplicates(), "links"))
    of_print = nodes.select("print", "node").join(labels, nodes.node == labels.id, "left").select("print", F.coalesce("component", "node").alias("class_id"))
    own = sketch.join(of_print.hint("merge"), "print", "left").select("doc_id", "print", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))
    own = written(own, "own-classes")
    # a row without words follows the other rows of its id
    bare = F.col("print").isNull() & F.col("doc_id").isNotNull()
    follow = own.filter(~bare).join(own.filter(bare).select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("class_id").alias("other"))
    followed = own.filter(bare).join(follow, "doc_id", "left").select("doc_id", F.coalesce("other", "doc_id").alias("class_id"))
    return own.filter(~bare).select("doc_id", "class_id").unionByName(followed).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class, the smallest doc_id; of rows that repeat it the one of the smallest text."""
    found = written(classes(docs, similarity), "classes")
    gone, row = free(docs, "__id", "__row")
    ids = found.filter(~F.col("kept")).select(F.col("doc_id").alias(gone)).dropDuplicates()
    left = docs.join(small(ids, IDS), F.col("doc_id").cast("long") == F.col(gone), "left_anti")
    several = written(found.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(gone)).count().filter("count > 1").select(gone), "repeated-ids")
    if several.isEmpty():
        return left
    same = F.col("doc_id").cast("long") == F.col(gone)
    repeats = left.join(several, same, "left_semi")
    sortable = [col(n) for n, kind in docs.dtypes if n != "text" and "map<" not in kind and "variant" not in kind]
    one = repeats.groupBy("doc_id").agg(F.min_by(F.struct(*map(col, docs.columns)), F.struct("text", *sortable)).alias(row))
    return left.join(several, same, "left_anti").unionByName(one.select(*[F.col(row)[c].alias(c) for c in docs.columns]))
