"""Language identification by nearest centroids of TF-IDF n-gram vectors, with distance-based rejection.

Texts become L2-normalised TF-IDF vectors of hashed byte bigrams and trigrams (ASCII letters lower-cased, other ASCII
bytes as spaces).  Document frequencies, several spherical k-means centroids for each language and the bounds of
rejection all come from every labelled row: each round of k-means is a pass over the rows that returns one sum per
centroid and n-gram, in integers, so that the order of rows does not matter.  A text takes the language of the centroid
of highest cosine, and is rejected if that cosine is below what the centroid asks of texts of its length: the geometric
mean of a low quantile of the cosines of the pieces of training text nearest to it (one of each text and length) and a
high quantile of those of random letters, both of that length.  Where the two overlap, as in texts of a few letters,
nothing is rejected.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and is rejected; with nothing to learn
from, every text is ``und``; a tie goes to the first language by code point; repeated rows stay; rows of null language
are predicted but not learned from; extra columns pass through, and columns named as the results are replaced.  Texts of
any length are used whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almoner.llm.common import blobs, chunks, col, fold, free, tidy

DIM = 4096
CENTROIDS = 4
#: Rounds of k-means at most, each a pass over the training rows; it ends before if no sum changes.
ROUNDS = 5
#: Vectors that a worker holds at once.
ROWS = 128
#: Sums of vectors are in units of 1 / SCALE.
SCALE = 1 << 24
#: Lengths in n-grams at which cosines are compared with those of random letters; between them the bound is interpolated.
LENGTHS = (12, 25, 50, 100, 200, 400, 800, 1600, 3200, 6400)
#: Quantiles of the members' and the random letters' cosines, and the cosines of a centroid and length it takes to have them.
OWN, CHANCE, ENOUGH = 0.01, 0.99, 30
#: Strings of random letters of each length, and the parts of 1 to which cosines are rounded for quantiles.
LETTERS, BINS = 2000, 1000

_LOG = np.log1p(np.arange(1024)).astype(np.float32)
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def grams(texts: list[bytes]) -> np.ndarray:
    """documents x DIM counts of hashed bigrams and trigrams within each text."""
    out = np.zeros((len(texts), DIM), np.int32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    b = np.frombuffer(b" ".join(texts).translate(_FOLD) + b"   ", np.uint8).astype(np.uint32)
    two = b[:-1] * 256 + b[1:]
    three = two[:-1] * 256 + b[2:]
    two, three = (two[: len(three)] * np.uint32(2654435761)) >> 20, ((three + 77) * np.uint32(2246822519)) >> 20
    start = 0
    for i, end in enumerate(ends):
        if (n := end - 1 - start) > 1:
            out[i] = np.bincount(two[start : start + n - 1], minlength=DIM)
            if n > 2:
                out[i] += np.bincount(three[start : start + n - 2], minlength=DIM)
        start = end
    return out


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Sublinear TF times IDF, rows of length 1 (or 0)."""
    v = (_LOG[counts] if counts.max(initial=0) < len(_LOG) else np.log1p(counts.astype(np.float32))) * idf
    return v / np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v))[:, None], 1e-9)


def parts(values: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of ``values`` of a bounded size and at most ROWS."""
    for lo, hi in chunks(values):
        for i in range(lo, hi, ROWS):
            yield i, min(hi, i + ROWS)


def pieces(text: bytes) -> list[tuple[int, bytes]]:
    """For each length that the text has: its place in LENGTHS, and a piece of the text."""
    seed, out = zlib.crc32(text), []
    for i, n in enumerate(LENGTHS):
        if (size := (n + 3) // 2) <= len(text):
            at = seed % (len(text) - size + 1)
            out.append((i, text[at : at + size]))
    return out


def letters(seed: int) -> list[tuple[int, bytes]]:
    """A string of random letters for each place in LENGTHS."""
    rng = np.random.default_rng(seed)
    return [(i, rng.integers(97, 123, (n + 3) // 2, np.uint8).tobytes()) for i, n in enumerate(LENGTHS)]


def quantile(counts: np.ndarray, q: float) -> float:
    """Of cosines counted by their BINS-th parts."""
    return float(np.searchsorted(np.cumsum(counts), q * counts.sum())) / BINS


def bounds(own: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """centroids x LENGTHS least cosines, of counts by centroid, length and cosine.  Too few cosines of one centroid give way to those of all, and a length without any to the next shorter one."""
    out = np.zeros(own.shape[:2])
    for i in range(len(LENGTHS)):
        if own[:, i].sum() < ENOUGH:
            out[:, i] = out[:, i - 1] if i else 0
            continue
        for j in range(len(own)):
            a, b = (x[j, i] if x[j, i].sum() >= ENOUGH else x[:, i].sum(0) for x in (own, odd))
            low, high = quantile(a, OWN), quantile(b, CHANCE)
            out[j, i] = np.sqrt(low * high) if low > high else 0
    return out


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray  # language index of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray  # centroids x LENGTHS: cosine under which a text is rejected

    def asked(self, near: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The cosine asked of texts of n n-grams whose nearest centroids are these."""
        at = np.interp(np.log(np.maximum(n, 1)), np.log(LENGTHS), range(len(LENGTHS)))
        lo = at.astype(int)
        hi = np.minimum(lo + 1, len(LENGTHS) - 1)
        return np.where(n < LENGTHS[0], 0, self.least[near, lo] + (at - lo) * (self.least[near, hi] - self.least[near, lo]))

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, the cosine, and whether that is too low, for each text."""
        counts = grams(texts)
        cos = weigh(counts, self.idf) @ self.centroids.T
        by_language = np.stack([cos[:, self.owner == k].max(1) for k in range(len(self.languages))], 1)
        best = by_language.argmax(1)
        high = np.clip(by_language[np.arange(len(best)), best], 0, 1)
        near = np.where(self.owner == best[:, None], cos, -1).argmax(1)
        return best, high, high < self.asked(near, counts.sum(1))


def _document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """For each hashed n-gram the number of texts that hold it, and the number of texts; one row per n-gram and task is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIM + 1, np.int64), 0
        for b in batches:
            values = blobs(b.column(0))
            for lo, hi in parts(values):
                total[:DIM] += (grams(values[lo:hi]) > 0).sum(0)
            n += len(values)
        total[DIM] = n
        tidy()
        yield pa.record_batch([pa.array(range(DIM + 1), pa.int32()), pa.array(total)], names=["gram", "df"])

    rows = texts.mapInArrow(count, "gram int, df long").groupBy("gram").agg(F.sum("df").alias("df")).collect()
    out = np.zeros(DIM + 1, np.int64)
    for r in rows:
        out[r.gram] = r.df
    return out[:DIM], int(out[DIM])


def _sums(rows: DataFrame, idf: np.ndarray, languages: list[str], owner: np.ndarray, towards: np.ndarray, less: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row goes to the place of its language (``owner``) whose direction, ``less`` a number, it points to most: the places' sums of vectors in units of 1 / SCALE, and their numbers of rows."""
    held = rows.sparkSession.sparkContext.broadcast((idf, {k: i for i, k in enumerate(languages)}, owner, towards, less))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, index, owner, towards, less = held.value
        total = np.zeros((len(owner), DIM + 1), np.int64)
        for b in batches:
            values, lang = blobs(b.column(0)), np.array([index[x] for x in b.column(1).to_pylist()])
            for lo, hi in parts(values):
                v = weigh(grams(values[lo:hi]), idf)
                near = np.where(owner == lang[lo:hi, None], v @ towards.T - less, -np.inf).argmax(1)
                v = np.rint(v * SCALE).astype(np.int32)
                for j in np.unique(near):
                    total[j, :DIM] += v[near == j].sum(0, dtype=np.int64)
                    total[j, DIM] += (near == j).sum()
        tidy()
        place, gram = total.nonzero()
        yield pa.record_batch([pa.array(place, pa.int32()), pa.array(gram, pa.int32()), pa.array(total[place, gram])], names=["place", "gram", "total"])

    got = rows.mapInArrow(add, "place int, gram int, total long").groupBy("place", "gram").agg(F.sum("total").alias("total")).toArrow()
    held.destroy()
    out = np.zeros((len(owner), DIM + 1), np.int64)
    out[got["place"].to_numpy(), got["gram"].to_numpy()] = got["total"].to_numpy()
    return out[:, :DIM], out[:, DIM]


def _unit(sums: np.ndarray) -> np.ndarray:
    return (sums / np.maximum(np.linalg.norm(sums.astype(np.float64), axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _kmeans(rows: DataFrame, idf: np.ndarray, languages: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means of each language's rows: centroids and their languages.  It starts from the rows' largest projection, from their language's mean, on ``k`` random directions."""
    owner = np.arange(len(languages))
    sums, n = _sums(rows, idf, languages, owner, np.zeros((len(owner), DIM), np.float32), np.zeros(len(owner)))
    if k == 1:
        return _unit(sums), owner
    towards = np.random.default_rng(0).standard_normal((k, DIM)).astype(np.float32)
    less = (sums / SCALE / n[:, None]) @ towards.T
    owner = np.repeat(owner, k)
    sums, n = _sums(rows, idf, languages, owner, np.tile(towards, (len(languages), 1)), less.ravel())
    for _ in range(ROUNDS):
        owner, last = owner[n > 0], sums[n > 0]
        sums, n = _sums(rows, idf, languages, owner, _unit(last), np.zeros(len(owner)))
        if np.array_equal(sums, last):
            break
    return _unit(sums[n > 0]), owner[n > 0]


def _cosines(rows: DataFrame, cut: Callable[[bytes | int], list[tuple[int, bytes]]], idf: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Counts, by nearest centroid, length and rounded cosine, of what ``cut`` makes of each row's only column."""
    held = rows.sparkSession.sparkContext.broadcast((idf, c))
    shape = (len(c), len(LENGTHS), BINS + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, c = held.value
        total = np.zeros(shape, np.int64)
        for b in batches:
            values = b.column(0).to_pylist() if pa.types.is_integer(b.column(0).type) else blobs(b.column(0))
            for lo in range(0, len(values), 20):
                if some := [p for x in values[lo : lo + 20] for p in cut(x)]:
                    length, texts = zip(*some, strict=True)
                    cos = weigh(grams(list(texts)), idf) @ c.T
                    np.add.at(total, (cos.argmax(1), np.array(length), np.rint(np.clip(cos.max(1), 0, 1) * BINS).astype(int)), 1)
        tidy()
        near, length, cos = total.nonzero()
        yield pa.record_batch([pa.array(x, pa.int32()) for x in (near, length, cos)] + [pa.array(total[near, length, cos])], names=["near", "length", "cos", "n"])

    got = rows.mapInArrow(count, "near int, length int, cos int, n long").groupBy("near", "length", "cos").agg(F.sum("n").alias("n")).toArrow()
    held.destroy()
    out = np.zeros(shape, np.int64)
    out[tuple(got[x].to_numpy() for x in ("near", "length", "cos"))] = got["n"].to_numpy()
    return out


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", centroids: int = CENTROIDS) -> Model | None:
    """Learn from all rows of non-null language and text with a letter; None if there are none."""
    rows = train.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    languages = sorted(r.lang for r in rows.select("lang").distinct().collect())
    if not languages:
        return None
    df, n = _document_frequencies(rows.select("text"))
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.05)
    c, owner = _kmeans(rows, idf, languages, centroids)
    least = bounds(_cosines(rows.select("text"), pieces, idf, c), _cosines(train.sparkSession.range(LETTERS), letters, idf, c))
    return Model(languages, owner, c, idf, least)


def _judged(docs: DataFrame, model: Model | None, text_col: str) -> tuple[DataFrame, str]:
    """``docs`` with one more column, a struct of lang_pred, lang_score and rejected, and its name."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array, letters: pa.Array) -> pa.Array:
        m, values, ok = held.value, blobs(texts), letters.to_pylist()
        names, scores, out = ["und"] * len(values), [0.0] * len(values), [True] * len(values)
        for lo, hi in parts(values) if m else ():
            for i, k, s, far in zip(range(lo, hi), *(x.tolist() for x in m.predict(values[lo:hi])), strict=True):
                if ok[i]:
                    names[i], scores[i], out[i] = m.languages[k], s, far
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())], ["lang_pred", "lang_score", "rejected"])

    text: Column = col(text_col).cast("string")
    udf = F.arrow_udf(run, "struct<lang_pred:string,lang_score:double,rejected:boolean>")
    (name,) = free(docs, "__lang")
    return docs.withColumn(name, udf(text, F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))), name


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred string, lang_score double, rejected boolean, in place of columns of these names."""
    rows, lang = _judged(docs, model, text_col)
    results = ("lang_pred", "lang_score", "rejected")
    return rows.select(*[col(c) for c in docs.columns if c.lower() not in results], *[F.col(lang)[c].alias(c) for c in results])


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with its columns."""
    rows, lang = _judged(docs, model, text_col)
    return rows.filter(~F.col(lang)["rejected"]).select(*map(col, docs.columns))


def training(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents that may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return docs.filter(fold(id_col, 3) != 1)
