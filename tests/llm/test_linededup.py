import hashlib
from collections import defaultdict

from almoner.llm import linededup
from tests.llm.conftest import prose


def brute(rows):
    holders = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(i)
    last = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if len(v) >= 5}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def corpus(n=60):
    shared = ["A Line That Many Documents Share, Number %d, OK" % k for k in range(4)]
    rows = [(i, "\n".join([prose(i, 8), *(f" {s}\t" if i % 2 else s.lower() for k, s in enumerate(shared) if i % (k + 2) == 0), "short", *([shared[0]] * (i % 3))])) for i in range(n)]
    return [*rows, (None, shared[0]), (3, rows[3][1]), (n, shared[1] + "\n" + "é" * 39), (n + 1, None)]


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert order(linededup.dedup_report(df).collect()) == order(brute(rows))


def test_many_small_batches_compact(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert order(linededup.dedup_report(df, batches=7, fanout=2).collect()) == order(brute(rows))


def test_runs_are_compacted_by_level_and_never_share_a_hash(spark):
    runs = linededup.Runs(spark, 2)
    for i in range(5):
        runs.add(spark.createDataFrame([(i, 1, 1), (i, i, 2)], "doc_id long, h1 long, h2 long"))
    assert [len(x) for x in runs.fresh] == [1, 0, 1] and [len(x) for x in runs.repeats] == [2, 1]
    keys = [(r.h1, r.h2) for level in runs.fresh for run in level for r in run.collect()]
    assert sorted(keys) == sorted([(1, 1), *((i, 2) for i in range(5))])
    assert {(r.h1, r.h2): (r.n_docs, r.max_doc) for r in runs.repeated(2).collect()} == {(1, 1): (5, 4)}
    runs.close()


def test_runs_are_joined_and_merged_without_a_shuffle(spark):
    runs = linededup.Runs(spark, 2)
    for i in range(2):
        runs.add(spark.createDataFrame([(i, 1, 1), (i, i, 2)], "doc_id long, h1 long, h2 long"))
    one, two = runs.fresh[0]
    for how in ("left_anti", "full_outer", "left"):
        plan = runs._with(one, two, how)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.close()


def test_texts_and_edge_rows(spark, edge, empty):
    rows = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    assert order(linededup.dedup_report(edge).collect()) == order(brute(rows))
    kept = linededup.dedup_lines(edge)
    assert kept.columns == edge.columns and sorted(map(repr, kept.collect())) == sorted(map(repr, edge.collect()))
    assert linededup.dedup_lines(empty).isEmpty() and linededup.dedup_report(empty).isEmpty()
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    digest = {(i, h) for i, _, _, h in brute(corpus())}
    assert {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in linededup.dedup_lines(df).collect()} == digest
