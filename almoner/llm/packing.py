"""Mixture-controlled packing: token windows filled from source queues by deficit round-robin in closed form.

Documents queue up by source.  Every window of ``WINDOW`` sequences takes from each queue its share of tokens; what a
whole number of tokens leaves over of a share, the deficit, carries into the next window.  As documents may be cut
anywhere, the round-robin's state before window k is a function of k alone: queue s has given
min(N_s, floor(p_s t)) tokens at virtual time t, and t is where all queues together have given k windows.  So each task
places its own documents from two small tables (tokens by queue, tokens by queue and partition), carrying deficits across
windows and partitions without a pass over the queues.  By default shares follow the queues' totals, so that all drain
together and every sequence but the last is full.

Up to ``QUEUES`` sources are a queue each.  More are grouped into as many queues by hash, and each such queue is itself a
deficit round-robin over its sources, in inner windows of what the queue gives to a window: two levels of the same closed
form, so that every source keeps its own share at any number of sources and no task holds them all.

Defined results: a null or empty text is one token, the end id; a null source is a source of its own; repeated rows are
packed each; a share of 0 has its turn when all positive shares are drained, by natural share, and negative shares are an
error; extra columns are ignored; an empty table gives an empty result.  Documents of any length are cut.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almoner.llm.common import slices, small, tidy, written

LENGTH = 4096
#: Sequences in a window: a source's share of a window is contiguous there.
WINDOW = 32
END = 2
#: Queues; more sources than this are grouped into as many queues, each with a round-robin of its own.
QUEUES = 1000
#: Windows whose state is held at once.
STATES = 512
#: Words whose ids a task remembers; words that are encoded at once.
CACHED_WORDS, AT_ONCE = 250_000, 8192

TOKENS_SCHEMA = "doc_id long, source string, queue string, n long, part long, start long, ids binary"
PIECES_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: ASCII signs that are pre-tokens of their own after letters; not apostrophes (contractions) and bars (special tokens).
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{}~"


@lru_cache(1)
def _tokenizer(path: str) -> tuple[object, np.ndarray]:
    """The tokenizer, and which ids end a word."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    if t.get_vocab_size() > 1 << 16:
        raise ValueError("the vocabulary has more than 65,536 ids")
    last = np.zeros(1 << 16, bool)
    last[[i for name, i in t.get_vocab().items() if name.endswith("</w>")]] = True
    return t, last


def _bytes(strings: pa.Array) -> list[bytes]:
    """The values of an array of strings without spaces; much faster than one by one."""
    if not len(strings):
        return []
    whole = pa.LargeListArray.from_arrays(pa.array([0, len(strings)], pa.int64()), strings.cast(pa.large_binary()))
    return pc.binary_join(whole, pa.scalar(b" ", pa.large_binary()))[0].as_buffer().to_pybytes().split(b" ")


class _Numbers(dict):
    """Numbers of values in the order in which they come, from ``first`` on."""

    def __init__(self, first: int) -> None:
        self.first = first

    def of(self, strings: pa.Array) -> tuple[np.ndarray, list[bytes]]:
        """Each string's number, each value being looked up once, and the values that are new."""
        d = strings.dictionary_encode()
        values = _bytes(d.dictionary)
        number = np.fromiter(map(self.get, values, repeat(-1)), np.int64, len(values))
        at = np.flatnonzero(number < 0)
        new, next_one = [values[i] for i in at.tolist()], self.first + len(self)
        number[at] = np.arange(next_one, next_one + len(at))
        self.update(zip(new, number[at].tolist(), strict=True))
        return number[d.indices.to_numpy()], new


class _Words:
    """Ids of words (runs between ASCII white space), each made of two parts: letters and the signs after them, or a whole word and nothing. Emptied when it is full."""

    def __init__(self, path: str) -> None:
        self.tokenizer, self.last = _tokenizer(path)
        self.empty()

    def empty(self) -> None:
        """Word 0 is the end, part 0 is empty and part 1 the end's id."""
        self.words, self.parts = _Numbers(1), _Numbers(2)
        self.first, self.second = np.array([1]), np.array([0])
        self.flat, self.start, self.size = np.array([END], "<u2"), np.array([0, 0]), np.array([0, 1])

    def encode(self, words: list[bytes]) -> tuple[list[np.ndarray], list[int]]:
        ids = []
        for lo in range(0, len(words), AT_ONCE):
            ids += [np.array(e.ids, "<u2") for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words[lo : lo + AT_ONCE]], add_special_tokens=False)]
        return ids, list(map(len, ids))

    def encode_letters(self, words: list[bytes]) -> tuple[list[np.ndarray], list[int]]:
        """Words of letters, each one pre-token, many at once: a word's last id is one that ends words."""
        out, sizes = [], []
        for lo in range(0, len(words), 2 * AT_ONCE):
            part = words[lo : lo + 2 * AT_ONCE]
            groups = [part[i : i + 64] for i in range(0, len(part), 64)]
            for own, e in zip(groups, self.tokenizer.encode_batch_fast([b" ".join(g).decode("utf-8", "replace") for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u2")
                ends = np.flatnonzero(self.last[ids])
                if len(ends) != len(own):  # a letter whose lower case is no letter
                    each, n = self.encode(own)
                    out += each
                    sizes += n
                else:
                    out.append(ids)
                    sizes += np.diff(ends, prepend=-1).tolist()
        return out, sizes

    def part(self, strings: pa.Array) -> np.ndarray:
        """The parts' numbers; new ones are encoded."""
        number, new = self.parts.of(strings)
        if new:
            letters = pc.utf8_is_alpha(pa.array(new, pa.large_binary()).view(pa.large_string())).to_numpy(zero_copy_only=False)
            order = np.argsort(~letters, kind="stable")
            some = int(letters.sum())
            values = [new[i] for i in order.tolist()]
            (a, n), (b, m) = self.encode_letters(values[:some]), self.encode(values[some:])
            size = np.array([*n, *m], np.int64)
            start = np.empty_like(size)
            start[order] = len(self.flat) + np.cumsum(size) - size
            self.start, self.size = np.concatenate([self.start, start]), np.concatenate([self.size, size[np.argsort(order)]])
            self.flat = np.concatenate([self.flat, *a, *b])
        return number

    def learn(self, words: list[bytes]) -> None:
        word = pa.array(words, pa.large_binary()).view(pa.large_string())
        stem = pc.ascii_lower(pc.utf8_rtrim(word, characters=_SIGNS))
        plain = pc.utf8_is_alpha(stem)
        first = self.part(pc.if_else(plain, stem, word))
        second, cut = np.zeros(len(words), np.int64), pc.binary_length(stem).to_numpy()
        two = np.flatnonzero(plain.to_numpy(zero_copy_only=False) & (cut < pc.binary_length(word).to_numpy()))
        if len(two):
            second[two] = self.part(pa.array([words[i][k:] for i, k in zip(two.tolist(), cut[two].tolist(), strict=True)], pa.large_binary()).view(pa.large_string()))
        self.first, self.second = np.concatenate([self.first, first]), np.concatenate([self.second, second])

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids and the end as little-endian 16-bit bytes."""
        if not texts:
            return []
        if len(self.words) > CACHED_WORDS:
            self.empty()
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        number, new = self.words.of(pc.list_flatten(split))
        at = np.insert(number, np.cumsum(pc.list_value_length(split).to_numpy()), 0)
        if new:
            self.learn(new)
        part = np.stack([self.first[at], self.second[at]], 1).ravel()
        size = self.size[part]
        total = np.cumsum(size)
        flat = self.flat[np.repeat(self.start[part] - total + size, size) + np.arange(total[-1])].tobytes()
        cuts = [0, *(2 * total[1::2][at == 0]).tolist()]
        return [flat[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """Every document's ids with its partition and its place in that partition's part of its source; in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, given = _Words(path), TaskContext.get().partitionId(), {}
        for whole in batches:
            for b, texts in slices(whole, 3, 1 << 20):
                ids = cache.ids(texts)
                n = [len(x) // 2 for x in ids]
                starts = []
                for s, k in zip(b.column(1).to_pylist(), n, strict=True):
                    starts.append(given.get(s, 0))
                    given[s] = starts[-1] + k
                yield pa.record_batch([*b.columns[:3], pa.array(n, pa.int64()), pa.array([part] * len(ids), pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "source", "queue", "n", "part", "start", "ids"])
        del cache, given
        tidy()

    raw = F.col("source").cast("string")
    source = F.when(raw.isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), raw))  # null last, apart from every name
    many = docs.select(source.alias("s")).distinct().count() > QUEUES
    queue = F.pmod(F.xxhash64(source), F.lit(QUEUES)).cast("string") if many else source
    return written(docs.select(F.col("doc_id").cast("long"), source.alias("source"), queue.alias("queue"), F.col("text").cast("string")).mapInArrow(run, TOKENS_SCHEMA), "tokens")


class Rounds:
    """The deficit round-robin over queues of ``totals`` tokens with ``shares``, window by window; queues of share 0 come when the others are drained."""

    def __init__(self, totals: list[int], shares: list[float], window: int) -> None:
        self.totals, self.window = np.array(totals, np.int64), max(1, int(window))
        p = np.array(shares, np.float64)
        if (p < 0).any() or not np.isfinite(p).all():
            raise ValueError("a share is a finite number of at least 0")
        late = p == 0
        if late.all():
            p, late = self.totals.astype(np.float64), np.zeros(len(p), bool)
        self.p = p / p.sum()
        self.delay = np.zeros(len(p))
        if late.any():
            self.delay[late] = float((self.totals[~late] / self.p[~late]).max())
            self.p[late] = self.totals[late] / max(1, self.totals[late].sum())
        self.end = float((self.delay + self.totals / np.maximum(self.p, 1e-300)).max()) * (1 + 1e-9) + 1

    def given(self, t: np.ndarray) -> np.ndarray:
        return np.minimum(self.totals, np.floor(np.maximum(t[:, None] - self.delay, 0) * self.p).astype(np.int64))

    def before(self, k: np.ndarray) -> np.ndarray:
        """len(k) x queues: tokens that each queue has given before window k; they add up to k windows."""
        out = []
        for i in range(0, len(k), STATES):
            want = np.minimum(k[i : i + STATES] * self.window, self.totals.sum())
            lo, hi = np.zeros(len(want)), np.full(len(want), self.end)
            for _ in range(100):
                mid = (lo + hi) / 2
                enough = self.given(mid).sum(1) >= want
                lo, hi = np.where(enough, lo, mid), np.where(enough, mid, hi)
            low = self.given(lo)
            low[want == 0] = 0
            jump = np.maximum(self.given(hi) - low, 0)
            rest = want - low.sum(1)
            out.append(low + np.clip(rest[:, None] - (np.cumsum(jump, 1) - jump), 0, jump))
        return np.concatenate(out)

    def edges(self, queue: int, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For windows k, ascending: what the queue has given before each, and what the queues before it give to it. STATES windows' states are held at once."""
        edge, lead = [], []
        for i in range(0, len(k), STATES):
            part = k[i : i + STATES]
            every = np.unique(np.concatenate([part, part + 1]))
            state = self.before(every)
            at = np.searchsorted(every, part)
            edge.append(state[at, queue])
            lead.append((state[at + 1, :queue] - state[at, :queue]).sum(1))
        return np.concatenate(edge), np.concatenate(lead)

    def windows(self, queue: int, lo: int, hi: int) -> np.ndarray:
        """Windows that may hold the queue's tokens lo to hi, and the one after each; not many more than tokens."""
        near = (2 * len(self.totals) + 2) // self.window + 2
        ends = np.array([lo, hi], np.int64)
        rank = lambda x: self.given((x + 1) / self.p[queue] + self.delay[queue]).sum(1) // self.window
        first, last = rank(ends)
        if last - first <= 4 * (hi - lo) + 8:
            return np.arange(max(0, first - near), last + near + 2)
        at = np.unique(np.concatenate([rank(np.arange(i, min(i + 4096, hi + 1), dtype=np.int64)) for i in range(lo, hi + 1, 4096)]))
        return np.unique(np.maximum(at[:, None] + np.arange(-near, near + 2), 0))

    def cut(self, queue: int, runs: list[tuple[int, int]]) -> list[list[tuple[int, int, int]]]:
        """For runs (at, n) of the queue's tokens, in their order there: slices (place among all tokens, length, window)."""
        out: list[list[tuple[int, int, int]]] = []
        lo = 0
        while lo < len(runs):  # so many runs at once that their tokens span few windows
            hi, span = lo + 1, max(1, int(STATES * self.window * self.p[queue]))
            while hi < len(runs) and runs[hi][0] + runs[hi][1] - runs[lo][0] <= span:
                hi += 1
            ks = self.windows(queue, runs[lo][0], runs[hi - 1][0] + runs[hi - 1][1])
            edge, lead = self.edges(queue, ks)
            first = (np.searchsorted(edge, [at for at, _ in runs[lo:hi]], "right") - 1).tolist()
            edge, lead, k = edge.tolist(), lead.tolist(), ks.tolist()
            for (x, n), w in zip(runs[lo:hi], first, strict=True):
                own, end = [], x + n
                while x < end:
                    while edge[w + 1] <= x:
                        w += 1
                    stop = min(end, edge[w + 1])
                    own.append((k[w] * self.window + lead[w] + x - edge[w], stop - x, k[w]))
                    x = stop
                out.append(own)
            lo = hi
        return out


def _pieces(columns: dict[str, list], outer: Rounds, index: dict[str, int], inner: dict[str, tuple[Rounds, dict[str, int]]], length: int) -> list[tuple[int, ...]]:
    """Pieces of documents given as doc_id, source, queue, part, n, at (their place in their source) and ids.

    ``inner``: the round-robin over its sources of each queue that has more than one.
    """
    runs: dict[tuple[str, str, int], list[int]] = {}
    for i, key in enumerate(zip(columns["queue"], columns["source"], columns["part"], strict=True)):
        runs.setdefault(key, []).append(i)
    rows: list[tuple[int, ...]] = []
    for (q, source, _), members in runs.items():
        members.sort(key=columns["at"].__getitem__)
        own = [(columns["at"][i], columns["n"][i]) for i in members]
        owner = list(range(len(own)))
        if q in inner:
            level, names = inner[q]
            slices = level.cut(names[source], own)
            flat = sorted((at, n, j, sum(x[1] for x in parts[:k])) for j, parts in enumerate(slices) for k, (at, n, _) in enumerate(parts))
            own, owner, skip = [x[:2] for x in flat], [x[2] for x in flat], [x[3] for x in flat]
        else:
            skip = [0] * len(own)
        for j, before, parts in zip(owner, skip, outer.cut(index[q], own), strict=True):
            i = members[j]
            ids, x = np.frombuffer(columns["ids"][i], "<u2").astype("<u4"), before
            for at, n, _ in parts:
                while n:
                    k = min(n, length - at % length)
                    rows.append((columns["doc_id"][i], x, k, zlib.crc32(ids[x : x + k].tobytes()), columns["n"][i], at // length, at % length))
                    at, x, n = at + k, x + k, n - k
    return rows


def pack(docs: DataFrame, tokenizer: str, shares: dict[str | None, float] | None = None, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``shares``: target token proportions by source; by default those of the sources' totals, and sources left out of
    ``shares`` keep their natural share.
    """
    got = tokens(docs, tokenizer)
    by_part = got.groupBy("queue", "source", "part").agg(F.sum("n").alias("n"))
    held = written(by_part.select("queue", "source", "part", (F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")).alias("base"), "n"), "queue-parts")
    whole = held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not whole:
        return docs.sparkSession.createDataFrame([], PIECES_SCHEMA)
    wanted = {"~" if k is None else f"={k}": float(v) for k, v in (shares or {}).items()}
    share = F.col("n") / F.lit(float(whole))
    if wanted:
        share = F.coalesce(F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv])[F.col("source")], share)
    sources = held.groupBy("queue", "source").agg(F.sum("n").alias("n")).withColumn("share", share)
    by_queue = sources.groupBy("queue").agg(F.sum("n").alias("n"), F.sum("share").alias("share"), F.count(F.lit(1)).alias("sources"))
    totals = sorted((r.queue, r.n, r.share, r.sources) for r in by_queue.collect())  # at most QUEUES + 1 rows
    outer = Rounds([n for _, n, _, _ in totals], [p for _, _, p, _ in totals], window * length)
    index = {q: i for i, (q, _, _, _) in enumerate(totals)}
    names = [x.split()[0] for x in PIECES_SCHEMA.split(", ")]

    def batch(rows: list[tuple[int, ...]]) -> list[pa.Array]:
        return [pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True)) or [[]] * len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                yield pa.record_batch(batch(_pieces({c: part.column(c).to_pylist() for c in part.schema.names}, outer, index, {}, length)), names=names)
        tidy()

    # one row per source and partition: broadcast while small, else a join on both, which no source can make uneven
    placed = got.join(small(held.select("source", "part", "base"), 100_000), ["source", "part"]).select("doc_id", "source", "queue", "part", "n", (F.col("base") + F.col("start")).alias("at"), "ids")
    if all(n == 1 for _, _, _, n in totals):
        return placed.mapInArrow(run, PIECES_SCHEMA)

    def grouped(docs: pa.Table, sources: pa.Table) -> pa.Table:
        columns = {c: docs[c].to_pylist() for c in docs.column_names}
        if not columns["queue"]:
            return pa.table(batch([]), names=names)
        q = columns["queue"][0]
        level = sorted(zip(*(sources[c][0].as_py() for c in ("names", "totals", "shares")), strict=True))
        own = Rounds([n for _, n, _ in level], [p for _, _, p in level], outer.p[index[q]] * outer.window)
        return pa.table(batch(_pieces(columns, outer, index, {q: (own, {s: i for i, (s, _, _) in enumerate(level)})}, length)), names=names)

    # a queue's sources as lists, sent to each of its partitions
    lists = sources.groupBy("queue").agg(F.collect_list("source").alias("names"), F.collect_list("n").alias("totals"), F.collect_list("share").alias("shares"))
    sent = held.select("queue", "part").dropDuplicates().join(lists, "queue")
    return placed.groupBy("queue", "part").cogroup(sent.groupBy("queue", "part")).applyInArrow(grouped, PIECES_SCHEMA)
