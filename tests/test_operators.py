import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from almoner.operators import aggregates, bloom, joins, posts, sorts, words
from almoner.sources import sinks

D = "donation_id string, project_id string, ddate string, donor_city string, donor_state string, donor_is_teacher string, total double"
P = "project_id string, school_city string, poverty_level string, primary_focus_subject string"


@pytest.fixture(scope="module")
def sides(spark):
    d = [("d1", "p1", "2011", "c", "CA", "f", 1.0), ("d2", "p1", "2012", "c", "ca", "f", 2.0), ("d3", "p9", "2013", "e", "NY", "t", 3.0), ("d4", "", "2014", "", "NY", "", 4.5), ("d5", "p2", "2015", "g", "", None, 5.0)]
    p = [("p1", "x", "low", "SCIENCE"), ("p1", "y", "low", "Life science"), ("p2", "z", "high", "Math"), ("p3", "w", "high", ""), ("", "v", "mid", None)]
    return spark.createDataFrame(d, D), spark.createDataFrame(p, P)


def ids(df):
    return sorted((r.donation_id or "", r.school_city or "") for r in df.collect())


INNER = [("d1", "x"), ("d1", "y"), ("d2", "x"), ("d2", "y"), ("d4", "v"), ("d5", "z")]


@pytest.mark.parametrize("strategy", joins.STRATEGIES)
def test_inner_strategies_agree(sides, strategy):
    assert ids(joins.join_donations_projects(*sides, strategy=strategy)) == INNER


def test_outer_joins_add_the_unmatched(sides):
    join = lambda how: ids(joins.join_donations_projects(*sides, how=how))
    assert join("left") == sorted([*INNER, ("d3", "")])
    assert join("right") == sorted([*INNER, ("", "w")])
    assert join("full") == sorted([*INNER, ("d3", ""), ("", "w")])


def test_the_strategy_is_used(sides):
    plan = lambda s: joins.join_donations_projects(*sides, strategy=s)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan("merge") and "ShuffledHashJoin" in plan("shuffle_hash") and "BroadcastHashJoin" in plan("broadcast")
    large = joins.join_donations_projects(*sides, strategy="broadcast", broadcast_rows=1)
    assert ids(large) == INNER


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_copies_are_never_broadcast(sides, how):
    """The optimizer takes the projects for small enough to send around before they are copied."""
    df = joins.join_donations_projects(*sides, how=how, strategy="salted", salts=50)
    assert ids(df) == (INNER if how == "inner" else sorted([*INNER, ("d3", "")]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_subject_bloom_and_recheck(sides):
    d, p = sides
    exact = ids(joins.join_donations_projects(d, p, subject="science"))
    assert exact == INNER[:4]
    for strategy in ("merge", "broadcast"):
        assert ids(joins.join_donations_projects(d, p, subject="science", strategy=strategy, bloom=True)) == exact
    loose = ids(joins.join_donations_projects(d, p, subject="science", bloom=True, recheck=False))
    assert set(exact) <= set(loose)
    assert ids(joins.join_donations_projects(d, p, min_total=4.0)) == INNER[4:]
    for bad in ({"how": "full", "bloom": True}, {"how": "full", "strategy": "broadcast"}, {"how": "right", "strategy": "salted"}, {"how": "cross"}):
        with pytest.raises(ValueError):
            joins.join_donations_projects(d, p, **bad)


def test_records(sides):
    got = {tuple(r) for r in joins.format_join_records(joins.join_donations_projects(*sides, how="full"), "city_date").collect()}
    assert ("d1|p1|c|2011|1.00", "p1|x|low|SCIENCE") in got and ("d3|p9|e|2013|3.00", "null|null|null|null") in got and ("null|null|null|null|null", "p3|w|high|") in got
    assert ("d4||2014||4.50", "|v|mid|null") in {tuple(r) for r in joins.format_join_records(joins.join_donations_projects(*sides), "date_city").collect()}


def test_last_row_wins(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "project_id string, at int, v string")
    assert sorted(map(tuple, joins.last_by(rows, "project_id", "at").select("project_id", "v").collect())) == [("a", "y"), ("b", "z")]


def test_bloom_has_no_false_negatives_and_merges(spark, tmp_path):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    odd, rest = df.filter("k % 2 = 1"), df.filter("k % 2 = 0")
    b = bloom.bloom_build(odd, "k", 20_000, 5)
    assert odd.filter(~bloom.bloom_probe(odd, "k", b)).isEmpty()
    wrong = rest.filter(bloom.bloom_probe(rest, "k", b)).count()
    assert wrong < 2500 * b.rate(2500) * 2 + 30
    audit = bloom.bloom_audit(df, "k", F.col("k") % 2 == 1, b).groupBy("cls").count().collect()
    assert [(r.cls, r["count"]) for r in audit] in ([], [("FALSE_POSITIVE", wrong)])
    parts = bloom.bloom_merge(bloom.bloom_build(odd.filter("k < 1000"), "k", 20_000, 5), bloom.bloom_build(odd.filter("k >= 1000"), "k", 20_000, 5))
    assert parts == b
    bloom.bloom_save(spark, b, str(tmp_path / "filter"))
    assert bloom.bloom_load(spark, str(tmp_path / "filter")) == b
    nulls = spark.createDataFrame([(None,)], "k string")
    assert not nulls.select(bloom.bloom_probe(nulls, "k", b).alias("x")).first().x
    with pytest.raises(ValueError):
        bloom.bloom_merge(b, bloom.bloom_build(odd, "k", 10_000, 5))


def test_sums(sides):
    got = {r.city: r.total_sum for r in aggregates.sum_by_city(sides[0]).collect()}
    assert got == {"C": 3.0, "": 4.5, "G": 5.0}
    order = [r.city for r in sorts.order_by_sum_desc(aggregates.sum_by_city(sides[0])).collect()]
    assert order == ["G", "", "C"]


def test_secondary_sort(spark):
    d = spark.createDataFrame([("a", "", "", "z", "ca", "f", 1.0), ("b", "", "", "Z", "CA", "f", 9.0), ("c", "", "", "a", "NY", "f", 5.0), ("e", "", "", "", "NY", "f", 5.0), ("f", "", "", "b", " ", "f", 2.125)], D)
    want = [("f", "  b 2.13"), ("b", "CA Z 9.00"), ("a", "ca z 1.00"), ("c", "NY a 5.00")]
    assert [tuple(r) for r in sorts.secondary_sort(d).collect()] == want
    assert [tuple(r) for r in sorts.secondary_sort(d, 3).collect()] == want
    parts = sorts.natural_key_partitions(sorts.with_place(d), 4).select(F.spark_partition_id().alias("p"), F.lower("donor_state").alias("s")).distinct()
    assert parts.groupBy("s").count().filter("count > 1").isEmpty()


def test_total_sort_partitions_are_disjoint_and_ranks_count_on(spark):
    df = spark.range(2000).select(F.pmod(F.xxhash64("id"), F.lit(500)).alias("k"), "id")
    s = sorts.total_sort(df, ["k", "id"], 3)
    bounds = s.groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("p").collect()
    assert all(a.hi <= b.lo for a, b in zip(bounds, bounds[1:], strict=False))
    assert "rangepartitioning" in s._jdf.queryExecution().executedPlan().toString()
    ranked = [(r.k, r.id) for r in sorts.global_rank(df, [F.col("k"), F.col("id")], 3).orderBy("rank").collect()]
    assert ranked == sorted(ranked) and len(ranked) == 2000


def test_shuffle_keeps_the_bag_and_samples_are_bounded(sides):
    d = sides[0]
    bag = lambda df: sorted(map(tuple, df.select("state", "city").collect()))
    assert bag(sorts.random_shuffle(d, 2, 1)) == [("CA", "c"), ("NY", "e"), ("ca", "c")]
    assert sorts.sample_keys(d, 2, seed=1).count() == 2 and sorts.sample_keys(d, 9, read_limit=1).count() == 1


def test_bad_number_fails(spark):
    with pytest.raises(Exception):
        sorts.swap_key_value(spark.createDataFrame([("a", "x")], "key string, value string")).collect()


LINES = ["", " ", " foo", "foo bar ", "--", "Foo1bar é foo", "a" * 49, "a" * 50]


@pytest.mark.parametrize(
    ("mode", "empties"),
    [("java", 1 + 0 + 1 + 0 + 0 + 0), ("python", 1 + 2 + 1 + 1 + 2 + 0), ("clean", 0)],
)
def test_tokenising(spark, mode, empties):
    counts = {r.word: r["count"] for r in words.word_count(spark.createDataFrame([(x,) for x in LINES], "value string"), mode).collect()}
    assert counts.pop("", 0) == empties
    assert counts == {"foo": 4, "bar": 2, "a" * 49: 1}


def test_top_words(spark):
    counts = spark.createDataFrame([("the", 5), ("of", 9), ("and", 5), ("cat", 1)], "word string, count long")
    assert [tuple(r) for r in words.top_words(counts, min_count=1, n=2).collect()] == [("and", 5), ("the", 5)]
    assert words.top_words(counts).isEmpty()


def test_posts(spark, tmp_path):
    t0 = datetime.datetime(2020, 1, 1, tzinfo=datetime.UTC)

    def uuid1(i):
        ticks = int((t0 + datetime.timedelta(hours=i)).timestamp() * 10_000_000) + 122192928000000000
        return str(uuid.UUID(fields=(ticks & 0xFFFFFFFF, ticks >> 32 & 0xFFFF, ticks >> 48 & 0x0FFF | 0x1000, 128, 1, 2)))

    rows = [("u", uuid1(i), f"post {i}") for i in range(120)] + [("v", uuid1(5), "other")]
    assert sorted(r[1] for r in rows[:120]) != [r[1] for r in rows[:120]]
    df = spark.createDataFrame(rows, "username string, creation string, content string")
    assert posts.posts_count(df).first().n == 121
    assert [r.content for r in posts.user_posts(df, "u").collect()] == [f"post {i}" for i in range(100)]
    assert [r.content for r in posts.user_posts(df, "u", 2, latest=True).collect()] == ["post 119", "post 118"]
    dated = posts.user_posts_with_date(df, "u").collect()
    assert len(dated) == 120 and dated[-1].creation_date == datetime.datetime(2020, 1, 1)
    assert posts.user_posts_with_date(df, "u", 3).count() == 3
    sinks.append_posts(df, str(tmp_path / "p"))
    sinks.append_posts(df.limit(1), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 122


def test_stream_counts_like_a_batch(spark, tmp_path):
    from almoner.streaming import words as stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("the cat\nthe dog\n")
    q = stream.stream_word_count(stream.stream_lines(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("streamed").start()
    q.processAllAvailable()
    q.stop()
    assert {r.word: r["count"] for r in spark.table("streamed").collect()} == {"the": 2, "cat": 1, "dog": 1}


def test_windowed_counts(spark):
    from almoner.streaming import words as stream

    rows = spark.createDataFrame([("a b", datetime.datetime(2020, 1, 1, 0, 1)), ("a", datetime.datetime(2020, 1, 1, 0, 7))], "value string, ts timestamp")
    assert sorted((r.window.start.minute, r.word, r["count"]) for r in stream.windowed_word_count(rows, "ts").collect()) == [(0, "a", 1), (0, "b", 1), (5, "a", 1)]
