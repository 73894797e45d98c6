import hashlib
import re
from collections import defaultdict

from almoner.llm import mixing
from tests.llm.conftest import prose


def brute(rows, total=None):
    """The mix by sorting each source's documents by hash."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    h = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)
    own = defaultdict(int)
    for i, t, s in rows:
        own[s] += size(t)
    order = sorted(own, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, target = sum(own.values()) if total is None else total, {}
    open_ = set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 3 * own[s]]
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            target[s] = 3 * own[s]
            left -= target[s]
            open_.remove(s)
    out = []
    for s in order:
        full = int(target[s] // own[s]) if own[s] else 0
        budget, keys = target[s] - full * own[s], defaultdict(int)
        for i, t, x in rows:
            if x == s:
                keys[h(i)] += size(t)
        before, more = 0, {}
        for k in sorted(keys):
            more[k] = before + keys[k] <= budget or before <= budget and (budget - before) * 2 >= keys[k]
            before += keys[k]
        out += [(i, size(t), own[s], target[s], size(t) * (full + more[h(i)])) for i, t, x in rows if x == s]
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:3] + r[4:] for r in got] == [tuple(r[:3] + r[4:]) for r in want]
    assert all(abs(a[3] - b[3]) <= 1e-9 * max(1, b[3]) for a, b in zip(got, want, strict=True))


def corpus(spark, n=600):
    rows = [(i, " ".join(["w"] * (i % 37)), None if i % 11 == 0 else f"s{i % 7 if i % 3 else 0}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_equals_sorting(spark):
    rows, df = corpus(spark)
    same(mixing.mix(df).collect(), brute(rows))


def test_edge_rows(spark, edge, empty):
    same(mixing.mix(edge).collect(), brute([tuple(r) for r in edge.select("doc_id", "text", "source").collect()]))
    assert mixing.mix(empty).isEmpty() and mixing.take(empty).isEmpty()
    taken = mixing.take(edge)
    assert taken.columns == edge.columns


def test_smaller_budgets_are_nested(spark):
    _, df = corpus(spark)
    small, large = ({r.doc_id: r.taken for r in mixing.mix(df, total=t).collect()} for t in (2000, 4000))
    assert all(small[i] <= large[i] for i in small) and sum(small.values()) < sum(large.values())


def test_take_repeats_documents(spark):
    rows, df = corpus(spark)
    want = {r.doc_id: r.taken // r.size for r in mixing.mix(df).collect() if r.size}
    got = {r.doc_id: r["count"] for r in mixing.take(df).groupBy("doc_id").count().collect()}
    assert {i: n for i, n in want.items() if n} == {i: n for i, n in got.items() if i in want}


def test_refines_below_the_first_level(spark, monkeypatch):
    rows, df = corpus(spark)
    monkeypatch.setattr(mixing, "LEVEL_BITS", 4)
    same(mixing.mix(df).collect(), brute(rows))


def test_plan_is_native(spark, edge):
    plan = mixing.mix(edge)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_take_keeps_columns_of_any_name(spark):
    rows = [(i, prose(i, 20), f"s{i % 3}", i, i, i, i, i) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, full long, threshold long, target long, source_size long, `a.b` long")
    got = mixing.take(df)
    assert got.columns == df.columns
    assert all(tuple(r)[3:] == (r.doc_id,) * 5 for r in got.collect()) and got.count() > 0
