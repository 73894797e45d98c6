import random
from collections import Counter

import numpy as np

from almoner.llm import bagminhash as bag
from tests.llm.conftest import prose


def multiset(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def brute(rows, least=0.8):
    sets = [multiset(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][0] is not None and rows[j][0] is not None and similarity(sets[i], sets[j]) >= least
            if same or rows[i][0] == rows[j][0]:
                label[root(i)] = root(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(root(i), []).append(rows[i][0])
    return [(rows[i][0], min((x for x in members[root(i)] if x is not None), default=None)) for i in range(len(rows))]


def edited(words, rng, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def corpus(seed=0):
    rng = random.Random(seed)
    texts = []
    for g in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([60, 150, 400]))]
        texts += [" ".join(base)] * 3 + [edited(base, rng, k) for k in (1, 1, 2, 3, 6, 12, 30)]
    texts += [" ".join(f"w{rng.randrange(3000)}" for _ in range(80)) for _ in range(20)]
    texts += ["a b c", "A  b\nc", "a b c d", "spam eggs " * 50, "spam eggs " * 45, "spam eggs " * 20]
    rng.shuffle(texts)
    return list(enumerate(texts))


def order(rows):
    return sorted([(r[0] is None, r[0] or 0, r[1] or 0) for r in rows])


def test_equals_brute_force(spark):
    rows = corpus()
    got = bag.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert order(r[:2] for r in got) == order(brute(rows)) and all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_one_large_group_of_near_copies(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    rows = list(enumerate(edited(base, rng, rng.choice([1, 2, 2, 3])) for _ in range(150)))
    monkeypatch.setattr(bag, "BLOCK", 32)
    got = bag.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert order(r[:2] for r in got) == order(brute(rows))


def test_registers_are_unbiased():
    rng = np.random.default_rng(0)
    off = []
    for _ in range(80):
        e, a = rng.integers(0, 2**63, 60).astype(np.uint64), rng.integers(0, 20, 60)
        b = np.where(rng.random(60) < 0.5, a, rng.integers(0, 20, 60))
        x, y = np.sort(np.repeat(e, a)), np.sort(np.repeat(e, b))
        s = bag.signatures([x, y])
        off.append((s[0] == s[1]).mean() - bag.jaccard(x, y))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06


def test_signatures_do_not_depend_on_company():
    bags = [bag.shingles(bag.words(t.encode())) for _, t in corpus(3)[:20]]
    together = bag.signatures(bags)
    assert all(np.array_equal(together[i], bag.signatures([b])[0]) for i, b in enumerate(bags))


def test_edge_rows(spark, edge, empty):
    rows = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    assert order(r[:2] for r in bag.classes(edge).collect()) == order(brute(rows))
    kept = bag.keep_one(edge)
    assert kept.columns == edge.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 6, 8, 9, 10] and ids.count(None) == 1
    assert bag.classes(empty).isEmpty() and bag.keep_one(empty).isEmpty()


def test_rows_of_one_id_share_a_class(spark):
    a, b, c = prose(1), prose(2), prose(3)
    rows = [(3, a), (5, a), (5, b), (7, b), (8, c), (9, None), (9, c), (None, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.class_id) for r in bag.classes(df).collect()}
    assert got == {(3, 3), (5, 3), (7, 3), (8, 8), (9, 8), (None, None)}
    assert sorted((r.doc_id or 0, r.text) for r in bag.keep_one(df).collect()) == sorted([(3, a), (8, c), (0, c)])


def test_components_in_few_rounds_whatever_the_order(spark, monkeypatch):
    from almoner.llm import graph

    n, rounds = 300, []
    made = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: rounds.append(name) or made(df, name))
    back = [x for i in range(n // 2) for x in (i, n - 1 - i)]
    for order in (list(range(n)), random.Random(1).sample(range(n), n), back):
        rounds.clear()
        edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long").coalesce(1)
        got = graph.connected(edges).collect()
        assert sorted(r.id for r in got) == list(range(n)) and {r.component for r in got} == {0} and len(rounds) <= 16
