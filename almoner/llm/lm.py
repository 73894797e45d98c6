"""Language-model scoring by a weighted backoff automaton over word n-grams.

States are histories: every training word, the text's boundary, and the empty history.  A state has an arc for each word
seen after it in training, absolutely discounted; any other word takes the failure arc to the empty history, which adds
the state's backoff weight, and the arc there: its discounted unigram, or for all words that training lacks, which are
one symbol, the discounts' mass.  Discounts come from the counts of counts.  Every text is traversed once from left to
right; as the state after a word is that word's own, a block of texts is traversed with array operations.

Counts of words and of pairs are exact over the whole training part and nowhere gathered in one place: tasks cut their
texts into blocks, each with its own word list; words meet by shuffle to be counted, and each block gets back the counts
of its own words only.  Each block then puts its pairs, counted, into buckets by their first word, where all blocks'
pairs meet, and gets back the counts of its own pairs and the backoff weights' parts of its own words.  Pairs of a first
word with over 1/HOT of all tokens are dealt by their second word, so that none fills a bucket; there are fewer than HOT
such words, and only their sums over buckets reach the driver.

Defined results: a null or empty text is its end token alone; with nothing to learn from, every
token is the unknown symbol, of probability 1; repeated rows count and are scored each; extra columns are ignored; an empty table gives an empty
result.  Long texts are whole, and a block's limits bound a task's memory.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almoner.llm.common import blobs, discard, fold, tidy, written

#: Limits of a block.
BLOCK_TOKENS, BLOCK_WORDS = 3_000_000, 320_000
#: Tokens for each bucket of pairs; share of the tokens from which a first word's pairs are dealt by the second.
BUCKET_TOKENS, HOT = 1_000_000, 1000
#: Bits of a word's number in its block, within its number in all.
ID_BITS = 27
#: Token of a text's end; no word is empty.
END = b""
ALPHA = 0.1

DOC, WORD = 0, 1
PARTS_SCHEMA = "block long, doc_id long, held_out boolean, n long, id int, word binary, ids binary, kind int"
PAIRS, WORDS, SUMS, TIMES = 0, 1, 2, 3
ARCS_SCHEMA = "kind int, block long, bucket int, n long, x long, y long, a binary, b binary, c binary, d binary, e binary"
SCORES_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def squeeze(ids: np.ndarray) -> bytes:
    return pa.compress(ids.tobytes(), codec="zstd", asbytes=True)


def expand(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.int32)


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers as zstd of their bytes, sorted by place."""
    return len(numbers).to_bytes(4, "little") + pa.compress(np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(pa.decompress(data[4:], 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<i8").ravel()


def split(text: bytes) -> list[bytes]:
    """Words: runs of bytes other than ASCII white space, with A-Z lower-cased."""
    return text.lower().split()


def discount(once: int, twice: int) -> float:
    """The share of a count to hold back, from how many things were seen once and twice."""
    return once / (once + 2 * twice) if once and twice else 0.5


@dataclass
class Unigrams:
    """The empty history."""

    tokens: int  # N
    distinct: int  # V
    held_back: float  # of each unigram count

    def empty_history(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the arcs from the empty history of words with these training counts."""
        if not self.tokens:
            return np.zeros(len(counts))
        return np.log10(np.where(counts > 0, counts - self.held_back, self.held_back * self.distinct) / self.tokens)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ALPHA) / (self.tokens + ALPHA * (self.distinct + 1)))


@dataclass
class Automaton(Unigrams):
    """Symbols: 0 any word that is no state, 1 to len(states) the states, then the boundary (start and end)."""

    states: dict[bytes, int]
    arcs: np.ndarray  # symbols x symbols, log10; NaN where only the failure arc leads on
    failure: np.ndarray  # log10 backoff weight of each symbol as history

    @property
    def boundary(self) -> int:
        return len(self.states) + 1

    def step(self, state: int, symbol: int, unigram: float) -> tuple[int, float]:
        """One token; the definition that ``score`` follows."""
        arc = float(self.arcs[state * (self.boundary + 1) + symbol])
        return symbol, float(self.failure[state]) + unigram if np.isnan(arc) else arc


def parts(docs: DataFrame, held_out: object, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as word numbers of their block (DOC rows), block word lists with training counts (WORD)."""
    names = [x.split()[0] for x in PARTS_SCHEMA.split(", ")]

    def batch(kind: int, count: int, /, **columns: object) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32()]
        columns["kind"] = [kind] * count
        return pa.record_batch([pa.array(columns[c], k) if c in columns else pa.nulls(count, k) for c, k in zip(names, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 20
        numbers: dict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        counts, total = np.zeros(BLOCK_WORDS, np.int64), 0

        def flush() -> Iterator[pa.RecordBatch]:
            words, own = list(numbers), counts[: len(numbers)]
            for lo in range(0, len(words), 50_000):
                part = words[lo : lo + 50_000]
                yield batch(WORD, len(part), block=[block] * len(part), id=np.arange(lo, lo + len(part), dtype=np.int32), word=part, n=own[lo : lo + 50_000])

        for b in batches:
            ids, texts, held = b.column(0).to_pylist(), blobs(b.column(1)), b.column(2).to_pylist()
            for lo in range(0, len(texts), 200):
                hi = min(lo + 200, len(texts))
                rows = []
                for t in texts[lo:hi]:
                    w = split(t)
                    w.append(END)
                    rows.append(np.fromiter(map(numbers.__getitem__, w), np.int32, len(w)))
                if len(numbers) > len(counts):
                    counts = np.concatenate([counts, np.zeros(max(len(counts), len(numbers)), np.int64)])
                train = [r for r, h in zip(rows, held[lo:hi], strict=True) if not h]
                if train:
                    got = np.bincount(np.concatenate(train))
                    counts[: len(got)] += got
                total += sum(map(len, rows))
                yield batch(DOC, hi - lo, block=[block] * (hi - lo), doc_id=ids[lo:hi], held_out=held[lo:hi], n=[len(r) for r in rows], ids=[squeeze(r) for r in rows])
                if total > BLOCK_TOKENS or len(numbers) > BLOCK_WORDS:
                    yield from flush()
                    block, total, counts = block + 1, 0, np.zeros(BLOCK_WORDS, np.int64)
                    numbers.clear()
        if numbers:
            yield from flush()
        numbers.clear()
        tidy()

    return written(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), held_out).mapInArrow(run, PARTS_SCHEMA), "lm-parts", partition_by="kind")


def word_counts(got: DataFrame) -> DataFrame:
    """Rows (block, id, word, c, whole, first): each block's words with their counts in all training texts and their numbers in all; first marks one row a word.

    Sums are partial before they meet, and the join can split a word that very many blocks hold.
    """
    words = got.filter(F.col("kind") == WORD).select("word", "n", (F.col("block") * (1 << ID_BITS) + F.col("id")).alias("own"))
    sums = words.groupBy("word").agg(F.sum("n").alias("c"), F.min("own").alias("whole"))
    block, number = F.shiftright("own", ID_BITS).alias("block"), F.col("own").bitwiseAND(F.lit((1 << ID_BITS) - 1)).cast("int").alias("id")
    return written(words.drop("n").join(sums.hint("merge"), "word").select(block, number, "word", "c", "whole", (F.col("own") == F.col("whole")).alias("first")), "lm-counts")


def unigrams(counts: DataFrame) -> Unigrams:
    times = lambda n: F.count(F.when(F.col("c") == n, 1))
    tokens, distinct, once, twice = counts.filter(F.col("first") & (F.col("c") > 0)).agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), times(1), times(2)).first()
    return Unigrams(int(tokens), int(distinct), discount(once, twice))


def table_of(schema: str, rows: list[dict]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.Table.from_pylist(rows, pa.schema([(n, kinds[k]) for n, k in map(str.split, schema.split(", "))]))


def adjacent(texts: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a block's texts laid end to end, the block's pairs (first word times size plus second, ascending), each token's pair, and the texts' lengths."""
    n = texts["n"].to_numpy()
    flat = np.concatenate([expand(x.as_py(), k) for x, k in zip(texts["ids"], n.tolist(), strict=True)])
    keys = np.empty(len(flat), np.int64)
    keys[0], keys[1:] = flat[-1], flat[:-1]  # a text begins where one ends
    keys *= size
    keys += flat
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.diff(keys, prepend=-1) != 0
    at = np.empty(len(flat), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    return flat, keys[new], at, n


def dealt(pairs: np.ndarray, size: int, slot: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of pairs by bucket, and the buckets with the start of each there."""
    a = pairs // size
    bucket = np.where(hot[a], slot[pairs - a * size], slot[a])
    order = np.argsort(bucket, kind="stable")
    return order, *np.unique(bucket[order], return_index=True)


def pair_counts(got: DataFrame, counts: DataFrame, m: Unigrams) -> DataFrame:
    """Rows of ARCS_SCHEMA.  For each block and bucket, PAIRS: the block's pairs' counts (a), and for each first word among
    them the number of words seen after it (b) and the sum of their counts (c).  For each block, WORDS: the words' counts
    (a) and buckets (b), and which are hot (c: words, d: numbers).  For hot words (n), SUMS in one bucket: the same two
    (x, y).  For each bucket, TIMES: pairs seen once (x) and twice (y)."""
    buckets = m.tokens // BUCKET_TOKENS + 1
    often = np.array(sorted(r.whole for r in counts.filter(F.col("first") & (F.col("c") * HOT > m.tokens)).select("whole").collect()), np.int64)

    def ask(texts: pa.Table, words: pa.Table) -> pa.Table:
        ids, block = words["id"].to_numpy(), words["block"][0].as_py()
        c, whole = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        c[ids], whole[ids] = words["c"].to_numpy(), words["whole"].to_numpy()
        slot = ((whole.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets
        hot = np.isin(whole, often)
        some = np.flatnonzero(hot)
        rows = [{"kind": WORDS, "block": block, "bucket": block % buckets, "a": pack(c), "b": pack(slot), "c": pack(some), "d": pack(whole[some])}]
        _, pairs, at, n = adjacent(texts, len(ids))
        train = np.repeat(~texts["held_out"].to_numpy(zero_copy_only=False).astype(bool), n)
        seen = np.bincount(at[train], minlength=len(pairs))
        del at, train
        order, there, starts = dealt(pairs, len(ids), slot, hot)
        for k, lo, hi in zip(there.tolist(), starts, [*starts[1:], len(order)], strict=True):
            part = order[lo:hi]
            a = pairs[part] // len(ids)
            b = pairs[part] - a * len(ids)
            new = np.flatnonzero(np.diff(a, prepend=-1))
            rows.append({"kind": PAIRS, "block": block, "bucket": k, "a": pack(whole[a[new]]), "b": pack(np.diff(new, append=len(a))), "c": pack(whole[b]), "d": pack(seen[part]), "e": pack(c[b])})
        del pairs, seen, order, whole, c, slot
        tidy()
        return table_of(ARCS_SCHEMA, rows)

    def meet(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        asked, out = [r for r in rows if r["kind"] == PAIRS], [r for r in rows if r["kind"] != PAIRS]
        if not asked:
            return table
        firsts, runs = [unpack(r["a"]) for r in asked], [unpack(r["b"]) for r in asked]
        names, first = np.unique(np.concatenate(firsts), return_inverse=True)
        second, b = np.unique(np.concatenate([unpack(r["c"]) for r in asked]), return_inverse=True)
        count = np.zeros(len(second), np.int64)
        count[b] = np.concatenate([unpack(r["e"]) for r in asked])
        pairs, at = np.unique(np.repeat(first, np.concatenate(runs)) * len(second) + b, return_inverse=True)
        total = np.bincount(at, np.concatenate([unpack(r["d"]) for r in asked]), len(pairs)).astype(np.int64)
        known = pairs[total > 0]
        after = np.bincount(known // len(second), minlength=len(names))
        mass = np.bincount(known // len(second), count[known % len(second)], len(names)).astype(np.int64)
        total_at, lo, word = total[at], 0, 0
        for r, f, run in zip(asked, firsts, runs, strict=True):
            hi, own = lo + int(run.sum()), first[word : word + len(f)]
            out.append({"kind": PAIRS, "block": r["block"], "bucket": r["bucket"], "a": pack(total_at[lo:hi]), "b": pack(after[own]), "c": pack(mass[own])})
            lo, word = hi, word + len(f)
        for i in np.flatnonzero(np.isin(names, often)):
            out.append({"kind": SUMS, "n": int(names[i]), "x": int(after[i]), "y": int(mass[i])})
        out.append({"kind": TIMES, "x": int((total == 1).sum()), "y": int((total == 2).sum())})
        del pairs, at, total_at, firsts, runs, first, second, b, asked, rows
        tidy()
        return table_of(ARCS_SCHEMA, out)

    texts = got.filter(F.col("kind") == DOC).select("block", "held_out", "n", "ids")
    words = counts.select("block", "id", "c", "whole")
    asked = texts.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(ask, ARCS_SCHEMA)
    return written(asked.groupBy("bucket").applyInArrow(meet, ARCS_SCHEMA), "lm-arcs", partition_by="kind")


def _pairs(train: DataFrame, states: dict[bytes, int]) -> np.ndarray:
    """symbols x symbols counts of adjacent tokens; all rows come to the driver."""
    size = len(states) + 2
    held = train.sparkSession.sparkContext.broadcast(states)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, edge, total = held.value.get, np.array([size - 1]), np.zeros(size * size, np.int64)
        for b in batches:
            texts = blobs(b.column(0))
            for lo in range(0, len(texts), 500):
                row = [edge]
                for t in texts[lo : lo + 500]:
                    w = split(t)
                    row += [np.fromiter(map(get, w, repeat(0)), np.int64, len(w)), edge]
                s = np.concatenate(row)
                total += np.bincount(s[:-1] * size + s[1:], minlength=size * size)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], names=["pair", "n"])

    table = train.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size, np.int64)
    out[table["pair"].to_numpy()] = table["n"].to_numpy()
    return out.reshape(size, size)


def fit(docs: DataFrame, counts: DataFrame, held_out: object, text_col: str = "text") -> Automaton:
    """The automaton of the training rows (those for which ``held_out`` is false) in one place, for small vocabularies."""
    m, known = unigrams(counts), counts.filter(F.col("first") & (F.col("c") > 0))
    top = known.filter(F.length("word") > 0).orderBy(F.desc("c"), "word").collect()
    names = {bytes(r.word): i + 1 for i, r in enumerate(top)}
    size = len(names) + 2
    m = Automaton(m.tokens, m.distinct, m.held_back, names, np.full(size * size, np.nan, np.float32), np.zeros(size))
    if not m.tokens:
        return m
    pairs = _pairs(docs.filter(~held_out).select(F.col(text_col).cast("string")), names).astype(np.float64)
    ends = pairs[:, -1].sum()
    unigram = np.zeros(size)
    unigram[1:] = 10.0 ** m.empty_history(np.array([*(r.c for r in top), ends]))
    history = pairs.sum(1)
    seen = pairs.copy()
    seen[0] = seen[:, 0] = 0  # no training word
    p = np.where(seen > 0, (seen - discount((seen == 1).sum(), (seen == 2).sum())) / np.maximum(history, 1)[:, None], 0)
    left = 1 - np.where(seen > 0, unigram[None, :], 0).sum(1)
    m.failure = np.log10(np.maximum(1 - p.sum(1), 1e-12) / np.maximum(left, 1e-12))
    m.failure[0] = 0.0
    m.arcs = np.where(p > 0, np.log10(np.maximum(p, 1e-300)), np.nan).astype(np.float32).ravel()
    return m


def score(got: DataFrame, arcs: DataFrame, m: Unigrams) -> DataFrame:
    """Every text of ``parts`` scored, block by block, with the counts of its block's words and pairs."""
    times = arcs.filter(F.col("kind") == TIMES).agg(F.coalesce(F.sum("x"), F.lit(0)), F.coalesce(F.sum("y"), F.lit(0))).first()
    held_back = discount(*times)
    often = {r.n: (r.x, r.y) for r in arcs.filter(F.col("kind") == SUMS).groupBy("n").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).collect()}
    names = [x.split()[0] for x in SCORES_SCHEMA.split(", ")]

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.to_pylist()
        words = next(r for r in answers if r["kind"] == WORDS)
        count, slot, some = unpack(words["a"]), unpack(words["b"]), unpack(words["c"])
        size, hot = len(count), np.zeros(len(count), bool)
        hot[some] = True
        flat, pairs, at, n = adjacent(texts, size)
        order, there, starts = dealt(pairs, size, slot, hot)
        place = {k: (lo, hi) for k, lo, hi in zip(there.tolist(), starts, [*starts[1:], len(order)], strict=True)}
        total, after, mass = np.zeros(len(pairs), np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        for r in answers:
            if r["kind"] == PAIRS:
                lo, hi = place[r["bucket"]]
                total[order[lo:hi]] = unpack(r["a"])
                own = pairs[order[lo:hi]] // size
                own = own[np.flatnonzero(np.diff(own, prepend=-1))]
                after[own], mass[own] = unpack(r["b"]), unpack(r["c"])
        for i, k in zip(some.tolist(), unpack(words["d"]).tolist(), strict=True):
            after[i], mass[i] = often[k]
        unigram, base = m.empty_history(count), m.base(count)
        back = np.maximum(held_back * after / np.maximum(count, 1), 1e-12) / np.maximum(1 - (mass - m.held_back * after) / max(m.tokens, 1), 1e-12)
        failure = np.where(count > 0, np.log10(back), 0.0)
        arc, first = np.empty(len(pairs)), np.concatenate([[0], np.cumsum(n)[:-1]])
        for lo in range(0, len(pairs), 500_000):
            a, t = pairs[lo : lo + 500_000] // size, total[lo : lo + 500_000]
            arc[lo : lo + 500_000] = np.where(t > 0, np.log10(np.maximum(t - held_back, 1e-300) / np.maximum(count[a], 1)), failure[a] + unigram[pairs[lo : lo + 500_000] - a * size])
        del order, total, pairs
        sums = {"n_known": ((count > 0).astype(np.int64), flat), "base_score": (base, flat), "score": (arc, at)}
        return pa.table({c: pa.array(np.add.reduceat(sums[c][0][sums[c][1]], first)) if c in sums else texts["n" if c == "n_tokens" else c] for c in names})

    texts = got.filter(F.col("kind") == DOC).select("block", "doc_id", "held_out", "n", "ids")
    answers = arcs.filter(F.col("kind").isin(PAIRS, WORDS)).select("block", "kind", "bucket", "a", "b", "c", "d")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, SCORES_SCHEMA)


def lm_scores(docs: DataFrame, folds: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document."""
    got = parts(docs, fold("doc_id", folds) == 0)
    counts = word_counts(got)
    m = unigrams(counts)
    arcs = pair_counts(got, counts, m)
    discard(counts)  # the scores need only the texts and the arcs
    discard(got, f"kind={WORD}")
    scores = score(got, arcs, m)
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(m.tokens).cast("long").alias("train_tokens"), "base_score", "score")
