import numpy as np

from almoner.llm import itq
from almoner.llm.graph import connected, extended


def brute(ids, vectors, threshold=0.9):
    n, dims = len(ids), [len(v) for v in vectors if v]
    dim = max(set(dims), key=lambda d: (dims.count(d), -d)) if dims else 0
    ok = [bool(v) and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    unit = [np.array(v, np.float64) / np.linalg.norm(v) if k else None for v, k in zip(vectors, ok, strict=True)]
    link = [[bool(ok[i] and ok[j] and i != j and (vectors[i] == vectors[j] or unit[i] @ unit[j] >= threshold)) for j in range(n)] for i in range(n)]
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if link[i][j] and label[j] < label[i]:
                    label[i], changed = label[j], True
    comp = {}
    for i in range(n):
        comp.setdefault(label[i], []).append(ids[i])
    return [(ids[i], sum(link[i]), min((x for x in comp[label[i]] if x is not None), default=ids[i])) for i in range(n)]


def order(rows):
    return sorted([(r[0] is None, r[0] or 0, r[1], r[2] or 0) for r in rows])


def run(spark, ids, vectors, **options):
    df = spark.createDataFrame(list(zip(ids, vectors, ["x"] * len(ids), strict=True)), "vec_id long, embedding array<float>, node string")
    return itq.links(df, **options).collect()


def groups(seed=0):
    rng = np.random.default_rng(seed)
    out = [v.tolist() for v in rng.normal(size=(60, 16)).astype(np.float32)]
    for k in range(8):
        base = rng.normal(size=16)
        out += [(base * rng.uniform(0.5, 2) + rng.normal(size=16) * 0.1).astype(np.float32).tolist() for _ in range(12)]
    return out + [out[0]] * 5 + [out[70]] * 3


def test_equals_brute_force(spark):
    vectors = groups()
    ids = np.random.default_rng(1).permutation(len(vectors)).tolist()
    got = run(spark, ids, vectors)
    assert order(r[:3] for r in got) == order(brute(ids, vectors)) and all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_cut_buckets_give_the_same(spark):
    vectors = groups(2)
    ids = list(range(len(vectors)))
    assert order(r[:3] for r in run(spark, ids, vectors, block=4)) == order(brute(ids, vectors))


def test_unusable_vectors_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [0.0] * 4, [1.0, None, 0.0, 0.0], [nan, 1.0, 0.0, 0.0], [inf, 1.0, 0.0, 0.0], [1.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0], [2.0, 0.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0], [0.0, 1e-30, 0.0, 0.0], [0.0, 1e30, 0.0, 0.0]]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 10, 11]
    assert order(r[:3] for r in run(spark, ids, vectors)) == order(brute(ids, vectors))
    got = run(spark, [None, 5], [[1.0, 0.0], [1.0, 0.0]])
    assert order(r[:3] for r in got) == order([(None, 1, 5), (5, 1, 5)])
    assert run(spark, [], []) == []


def planted(shift, n=4000, dim=64):
    """Unit vectors around a common mean of length ``shift`` and their partners at a cosine of 0.905."""
    rng = np.random.default_rng(3)
    x = itq.unit(rng.normal(size=(n, dim)) / np.sqrt(dim) + shift * itq.unit(rng.normal(size=(1, dim))))
    return x, itq.turned(x, 0.905, 5)


def test_recall_at_the_threshold():
    for shift in (0.0, 0.7):
        x, y = planted(shift)
        index = itq.fit(np.concatenate([x, y])[::2], 8000)
        a, b = index.keys(x), index.keys(y)
        within = (index.on(x) != index.on(y)).sum(1) <= index.radius
        assert ((a == b).any(1) & within).mean() >= 0.95
        bits = ((a[:, 0, None] >> np.arange(index.bits)) & 1).mean(0)
        assert (abs(bits - 0.5) < 0.1).all()


def test_recall_of_the_query_with_a_common_mean(spark):
    x, y = planted(0.7, 400, 32)
    vectors = np.concatenate([x, y]).astype(np.float32)
    unit = itq.unit(vectors.astype(np.float64))
    want = int((np.triu(unit @ unit.T, 1) >= 0.9).sum())
    got = sum(r.n_links for r in run(spark, list(range(len(vectors))), vectors.tolist())) / 2
    assert 0.95 * want <= got <= want


def test_candidates_are_the_pairs_within_the_radius():
    rng = np.random.default_rng(4)
    keys, side = rng.integers(0, 4, (60, 5)).astype(np.int32), rng.integers(1, 3, 60)
    for sides in (side, side * 0):
        got = set(map(tuple, itq._candidates(keys, sides, 2, 3, 2).tolist()))
        want = set()
        for i in range(60):
            for j in range(i + 1, 60):
                apart = sum(int(a ^ b).bit_count() for a, b in zip(keys[i], keys[j], strict=True))
                if apart <= 3 and not (keys[i, :2] == keys[j, :2]).any() and (not sides.any() or sides[i] != sides[j]):
                    want.add((i, j))
        assert got == want and want


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 9), (9, 7), (1, 1)]
    got = {r.id: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 7: 3, 9: 3}


def test_components_extended_by_more_edges(spark):
    rng = np.random.default_rng(4)
    parts = [[tuple(map(int, e)) for e in rng.integers(low, low + 120, (50, 2))] for low in (0, 40, 90)] + [[(1, 1)], []]
    frames = [spark.createDataFrame(p, "a long, b long") for p in parts]
    labels = connected(frames[0])
    for f in frames[1:]:
        labels = extended(labels, f)
    whole = connected(spark.createDataFrame(sum(parts, []), "a long, b long"))
    assert sorted(map(tuple, labels.select("id", "component").collect())) == sorted(map(tuple, whole.select("id", "component").collect()))
    none = connected(frames[-1])
    assert extended(none, frames[-1]).isEmpty()
    assert extended(none, frames[0]).count() == connected(frames[0]).count()
