import zlib
from collections import defaultdict

import numpy as np
import pytest

from almoner.llm import packing
from almoner.llm.queries import tokenizer_path
from tests.llm.conftest import prose

TEXTS = ["It's a TEST, of words### and don't!!", "naïve Ünïcode 漢字 ½ x²", "<|endoftext|> a<|endoftext|>b", "", "  \n ", "a\x1cb c d", "word. word, (word) word's 123abc ab12.", "é ́x"]


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda x: [*t.encode(x or "", add_special_tokens=False).ids, packing.END]


def test_ids_by_words_are_the_tokenizers(encode):
    texts = [*TEXTS, prose(1)]
    got = packing._Words(tokenizer_path()).ids([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [encode(t) for t in texts]


def whole(pieces, docs, encode, length):
    """Every id in exactly one piece, sequences without gaps, all full but the last."""
    ids = defaultdict(list)
    for i, t in docs:
        ids[i].append(encode(t))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        have = sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in own)
        if len(ids[i]) == 1:
            at = 0
            for start, n, crc, total in have:
                assert start == at and total == len(ids[i][0]) and crc == zlib.crc32(np.array(ids[i][0][start : start + n], "<u4").tobytes())
                at += n
            assert at == len(ids[i][0])
        else:
            assert sum(n for _, n, _, _ in have) == sum(map(len, ids[i]))
    for s, own in by_seq.items():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == length or s == max(by_seq) and at <= length
    assert sorted(by_seq) == list(range(len(by_seq)))


def corpus(spark, n=120):
    rows = [(i, prose(i, 20 + 13 * (i % 17)), f"s{i % 5 if i % 3 else 0}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)


def test_packs_whole_and_in_proportion(spark, encode):
    rows, df = corpus(spark)
    pieces = packing.pack(df, tokenizer_path(), length=256, window=4).collect()
    whole(pieces, [r[:2] for r in rows], encode, 256)
    source = {i: s for i, _, s in rows}
    total, windows = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for p in pieces:
        total[source[p.doc_id]] += p.length
        windows[p.sequence_id // 4][source[p.doc_id]] += p.length
    n = sum(total.values())
    for w, own in windows.items():
        size = sum(own.values())
        for s, t in total.items():
            assert abs(own[s] - size * t / n) <= 2


def test_other_shares_lead_in_the_first_windows(spark, encode):
    rows, df = corpus(spark)
    pieces = packing.pack(df, tokenizer_path(), shares={"s0": 0.1, "s1": 0.6, "s2": 0.1, "s3": 0.1, "s4": 0.1}, length=256, window=4).collect()
    whole(pieces, [r[:2] for r in rows], encode, 256)
    source = {i: s for i, _, s in rows}
    first = sum(p.length for p in pieces if p.sequence_id < 4 and source[p.doc_id] == "s1")
    assert abs(first - 0.6 * 1024) <= 2


def test_rounds_carry_deficits_and_add_up():
    totals, shares = [1000, 7, 333, 1], [0.5, 0.01, 0.4, 0.09]
    r = packing.Rounds(totals, shares, 64)
    got = r.before(np.arange(0, 23))
    assert (got.sum(1) == np.minimum(np.arange(0, 23) * 64, 1341)).all() and (np.diff(got, axis=0) >= 0).all() and (got[-1] == totals).all()


def test_edge_rows(spark, edge, empty, encode):
    pieces = packing.pack(edge, tokenizer_path()).collect()
    whole(pieces, [tuple(r) for r in edge.select("doc_id", "text").collect()], encode, packing.LENGTH)
    assert packing.pack(empty, tokenizer_path()).isEmpty()


def in_proportion(pieces, source, share, window, off):
    """Each window holds each source's share, to within ``off`` tokens, while all sources last."""
    windows = defaultdict(lambda: defaultdict(int))
    for p in pieces:
        windows[p.sequence_id // 4][source[p.doc_id]] += p.length
    for w in range(window):
        size = sum(windows[w].values())
        assert all(abs(windows[w][s] - size * p) <= off for s, p in share.items()), w


def test_more_sources_than_queues_keep_their_shares(spark, encode, monkeypatch):
    rows = [(i, prose(i, 40), f"s{i % 12}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    monkeypatch.setattr(packing, "QUEUES", 3)
    source, tokens = {i: s for i, _, s in rows}, defaultdict(int)
    for i, t, s in rows:
        tokens[s] += len(encode(t))
    pieces = packing.pack(df, tokenizer_path(), length=128, window=4).collect()
    whole(pieces, [r[:2] for r in rows], encode, 128)
    in_proportion(pieces, source, {s: n / sum(tokens.values()) for s, n in tokens.items()}, 8, 6)
    shares = {f"s{i}": 0.3 if i == 5 else 0.7 / 11 for i in range(12)}
    pieces = packing.pack(df, tokenizer_path(), shares=shares, length=128, window=4).collect()
    whole(pieces, [r[:2] for r in rows], encode, 128)
    in_proportion(pieces, source, shares, 2, 6)


def test_a_share_of_zero_comes_last(spark, encode):
    rows, df = corpus(spark)
    pieces = packing.pack(df, tokenizer_path(), shares={"s0": 0.5, "s1": 0.25, "s2": 0.25, "s3": 0, "s4": 0}, length=256, window=4).collect()
    whole(pieces, [r[:2] for r in rows], encode, 256)
    source = {i: s for i, _, s in rows}
    place = lambda p: p.sequence_id * 256 + p.offset
    late = [place(p) for p in pieces if source[p.doc_id] in ("s3", "s4")]
    assert min(late) >= sum(p.length for p in pieces if source[p.doc_id] not in ("s3", "s4"))
    whole(packing.pack(df, tokenizer_path(), shares=dict.fromkeys(["s0", "s1", "s2", "s3", "s4"], 0), length=256, window=4).collect(), [r[:2] for r in rows], encode, 256)
    with pytest.raises(ValueError):
        packing.pack(df, tokenizer_path(), shares={"s0": -1})


def test_a_rare_queue_needs_few_windows():
    r = packing.Rounds([10**9, 3], [1 - 4e-9, 4e-9], 100)
    assert len(r.windows(1, 0, 3)) < 50
    (parts,) = r.cut(1, [(0, 3)])
    assert [n for _, n, _ in parts] == [1, 1, 1] and len({k for _, _, k in parts}) == 3
    full = packing.Rounds([5000, 700, 44], [0.3, 0.5, 0.2], 64)
    state = full.before(np.arange(0, 91))
    for q in range(3):
        got = [x for own in full.cut(q, [(i, 1) for i in range(full.totals[q])]) for x in own]
        assert all(state[k, q] <= i < state[k + 1, q] and at == k * 64 + (state[k + 1, :q] - state[k, :q]).sum() + i - state[k, q] for i, (at, _, k) in enumerate(got))
