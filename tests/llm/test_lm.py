import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from almoner.llm import lm
from tests.llm.conftest import prose


def words(t):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))] + [lm.END]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def brute(rows, model):
    """Base scores by definition, scores by the automaton's single steps."""
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v, out = sum(c.values()), len(c), []
    for i, t in rows:
        w = words(t)
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        state, score = model.boundary, 0.0
        for x in w:
            u = float(model.empty_history(np.array([c[x]]))[0])
            state, p = model.step(state, model.boundary if x == lm.END else model.states.get(x, 0), u)
            score += p
        out.append((i, held(i), len(w), sum(c[x] > 0 for x in w), n, base, score))
    return out


def fitted(df):
    h = lm.fold("doc_id", 10) == 0
    got = lm.parts(df, h)
    return lm.fit(df, lm.word_counts(got), h)


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got, want = sorted(map(tuple, lm.lm_scores(df).collect()), key=key), sorted(brute(rows, fitted(df)), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-6)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(i, prose(i, 30 + i, 150) + (" Zipf the THE the" if i % 2 else "")) for i in range(80)], "doc_id long, text string").repartition(5)


def test_equals_brute_force(corpus):
    check(corpus)


def test_blocks_are_cut_without_a_trace(corpus, monkeypatch):
    whole = sorted(map(tuple, lm.lm_scores(corpus).collect()))
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(lm, "BLOCK_WORDS", 60)
    assert np.allclose([r[2:] for r in sorted(map(tuple, lm.lm_scores(corpus).collect()))], [r[2:] for r in whole])


def test_histories_have_proper_distributions(corpus):
    m = fitted(corpus)
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    known = list(c)
    u = 10.0 ** m.empty_history(np.array([*(c[w] for w in known), 0]))
    assert abs(u.sum() - 1) < 1e-9
    symbols = [m.boundary if w == lm.END else m.states.get(w, 0) for w in known] + [0]
    for state in (0, m.boundary, 1, 5):
        assert abs(sum(10.0 ** m.step(state, s, math.log10(p))[1] for s, p in zip(symbols, u, strict=True)) - 1) < 1e-4


def test_pairs_help(spark):
    df = spark.createDataFrame([(i, "alpha beta gamma delta " * 20 + prose(i, 40, 150)) for i in range(60)], "doc_id long, text string")
    got = lm.lm_scores(df).collect()
    assert all(r.score > r.base_score for r in got)


def test_edge_rows(spark, edge, empty):
    check(edge)
    assert lm.lm_scores(empty).isEmpty()
    lone = next(i for i in range(100) if held(i))
    got = lm.lm_scores(spark.createDataFrame([(lone, "a b"), (lone, None)], "doc_id long, text string")).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in got)


def test_pairs_of_rare_words_count(spark, monkeypatch):
    """Backoff scores by definition, over more words than any fixed number of states, in several blocks and buckets."""
    rows = [(i, prose(i // 2, 60, 5000) + " rare pair" * (i % 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    train = [words(t) for i, t in rows if not held(i)]
    c, pairs = Counter(x for w in train for x in w), Counter(p for w in train for p in zip([lm.END, *w], w, strict=False))
    n, v = sum(c.values()), len(c)
    assert v > 2000
    held_back = lambda counts: lm.discount(*(sum(x == k for x in counts.values()) for k in (1, 2)))
    d1, d2 = held_back(c), held_back(pairs)
    p1 = lambda x: (c[x] - d1 if c[x] else d1 * v) / n
    after = {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)

    def p2(a, b):
        if not c[a] or pairs[a, b]:
            return (pairs[a, b] - d2) / c[a] if c[a] else p1(b)
        return d2 * len(after[a]) / c[a] / (1 - sum(map(p1, after[a]))) * p1(b)

    want = {i: sum(math.log10(p2(a, b)) for a, b in zip([lm.END, *words(t)], words(t), strict=False)) for i, t in rows}
    for tokens, hot in ((10**6, 1000), (500, 1000), (500, 20)):
        monkeypatch.setattr(lm, "BUCKET_TOKENS", tokens)
        monkeypatch.setattr(lm, "HOT", hot)
        monkeypatch.setattr(lm, "BLOCK_TOKENS", 1500)
        got = {r.doc_id: r.score for r in lm.lm_scores(df).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)
