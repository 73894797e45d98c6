"""The registered queries over the star-schema tables, each with its DuckDB counterpart."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almoner import schemas
from almoner.functions import expressions as E
from almoner.operators import aggregates, bloom, joins, posts, sorts, words
from almoner.plans.session import scratch_path
from almoner.sources import adapters, readers, sinks

SUBJECT = "widget"
USER = "7"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


DONATIONS = """
donations AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS donation_id, CAST(l_partkey AS VARCHAR) AS project_id,
         n_name AS donor_city, r_name AS donor_state, CASE WHEN l_returnflag = 'R' THEN 't' ELSE 'f' END AS donor_is_teacher,
         strftime(l_shipdate, '%Y-%m-%d') AS ddate, l_extendedprice AS total, l_quantity AS amount, l_discount AS support, l_linestatus, l_linenumber, l_returnflag
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
PROJECTS = """
projects AS (SELECT CAST(p_partkey AS VARCHAR) AS project_id, p_brand AS school_city, p_type AS poverty_level, p_name AS primary_focus_subject, p_size FROM part)"""
SIDES = f"""{DONATIONS}, {PROJECTS},
d AS (SELECT donation_id, project_id, ddate, donor_city, total FROM donations),
p AS (SELECT project_id, school_city, poverty_level, primary_focus_subject FROM projects)"""
SUMS = f"""{DONATIONS},
sums AS (SELECT upper(donor_city) AS city, CAST(sum(CAST(total AS DECIMAL(18,2))) AS DOUBLE) AS total_sum FROM donations WHERE donor_is_teacher <> 't' GROUP BY 1)"""


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return adapters.donations(spark, d), adapters.projects(spark, d)


def _join_sql(how: str, where: str = "") -> str:
    return f"""WITH {SIDES}
SELECT coalesce(d.project_id, p.project_id) AS project_id, donation_id, ddate, donor_city, total, school_city, poverty_level, primary_focus_subject,
       d.project_id IS NOT NULL AS has_donation, p.project_id IS NOT NULL AS has_project
FROM d {how} JOIN p ON d.project_id = p.project_id {where}"""


# aggregates and order


@query(f"WITH {SUMS} SELECT city, total_sum FROM sums")
def sum_by_city(spark, d):
    return aggregates.sum_by_city(adapters.donations(spark, d))


@query(f"WITH {SUMS} SELECT total_sum, city FROM sums")
def order_by_sum_desc(spark, d):
    return sorts.order_by_sum_desc(aggregates.sum_by_city(adapters.donations(spark, d)))


@query(f"WITH {SUMS} SELECT total_sum, city, row_number() OVER (ORDER BY total_sum DESC, city) AS rank FROM sums")
def order_by_sum_desc_rank(spark, d):
    return sorts.global_rank(aggregates.sum_by_city(adapters.donations(spark, d)), [F.desc("total_sum"), F.asc("city")])


@query(f"WITH {DONATIONS} SELECT donation_id, donor_state, donor_city, total, row_number() OVER (ORDER BY lower(donor_state), lower(donor_city), total DESC, donation_id) AS rank FROM donations WHERE donor_state <> '' AND donor_city <> ''")
def secondary_sort_rank(spark, d):
    rows = sorts.with_place(adapters.donations(spark, d)).select("donation_id", "donor_state", "donor_city", "total")
    return sorts.global_rank(rows, [*sorts.composite_order(), F.col("donation_id")])


@query(f"WITH {DONATIONS} SELECT donation_id, donor_state || ' ' || donor_city || ' ' || printf('%.2f', total) AS label FROM donations WHERE donor_state <> '' AND donor_city <> ''")
def secondary_sort(spark, d):
    return sorts.secondary_sort(adapters.donations(spark, d))


@query(f"WITH {DONATIONS} SELECT donation_id, donor_state, row_number() OVER (ORDER BY donor_state, donation_id) AS rank FROM donations WHERE donor_state <> '' AND donor_city <> ''")
def total_sort_state(spark, d):
    rows = sorts.with_place(adapters.donations(spark, d)).select("donation_id", "donor_state")
    return sorts.global_rank(rows, [F.col("donor_state"), F.col("donation_id")])


@query(f"WITH {DONATIONS} SELECT donation_id, donor_state, donor_city, total, row_number() OVER (ORDER BY lower(donor_state), lower(donor_city), total, donation_id) AS rank FROM donations WHERE donor_state <> '' AND donor_city <> ''")
def total_sort_composite(spark, d):
    """The composite key's natural order, in which the total ascends."""
    rows = sorts.with_place(adapters.donations(spark, d)).select("donation_id", "donor_state", "donor_city", "total")
    return sorts.global_rank(rows, [*sorts.composite_order("asc"), F.col("donation_id")])


@query("SELECT o_orderpriority AS key, CAST(o_orderkey AS VARCHAR) AS value, row_number() OVER (ORDER BY o_orderpriority, CAST(o_orderkey AS VARCHAR)) AS rank FROM orders")
def kv_total_sort(spark, d):
    lines = adapters.table(spark, d, "orders").select(F.concat_ws("\t", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("value"))
    return sorts.global_rank(readers.key_values(lines), [F.col("key"), F.col("value")])


@query("SELECT c_name AS key, '' AS value FROM customer")
def kv_without_tab(spark, d):
    return readers.key_values(adapters.table(spark, d, "customer").select(F.col("c_name").alias("value")))


@query("SELECT CAST(CAST(o_totalprice AS VARCHAR) AS FLOAT) AS total_sum, CAST(o_orderkey AS VARCHAR) AS city FROM orders")
def swap_key_value(spark, d):
    pairs = adapters.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("value"))
    return sorts.swap_key_value(pairs)


@query(f"WITH {DONATIONS} SELECT donor_state AS state, donor_city AS city FROM donations WHERE donor_state <> '' AND donor_city <> ''")
def shuffle_state_city(spark, d):
    return sorts.random_shuffle(adapters.donations(spark, d), 2, 42)


@query(f"WITH {DONATIONS} SELECT CAST(least(500, count(*)) AS BIGINT) AS n FROM donations WHERE donor_state <> '' AND donor_city <> ''")
def sample_keys_size(spark, d):
    return aggregates.row_count(sorts.sample_keys(adapters.donations(spark, d), 500, seed=42))


@query(f"""WITH {DONATIONS} SELECT donor_state, donor_city, donation_id, total, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY donor_state, donor_city ORDER BY total DESC, donation_id) AS rank FROM donations) WHERE rank <= 3""")
def top_donations_per_city(spark, d):
    rows = adapters.donations(spark, d).select("donor_state", "donor_city", "donation_id", "total")
    return aggregates.top_per_group(rows, ["donor_state", "donor_city"], [F.desc("total"), F.asc("donation_id")], 3)


# joins


@query(_join_sql("INNER"))
def join_inner_merge(spark, d):
    return joins.join_donations_projects(*_sides(spark, d), strategy="merge")


@query(_join_sql("INNER"))
def join_inner_shuffle_hash(spark, d):
    return joins.join_donations_projects(*_sides(spark, d), strategy="shuffle_hash")


@query(_join_sql("INNER"))
def join_inner_broadcast(spark, d):
    return joins.join_donations_projects(*_sides(spark, d), strategy="broadcast")


@query(_join_sql("INNER"))
def join_inner_salted(spark, d):
    return joins.join_donations_projects(*_sides(spark, d), strategy="salted")


@query(_join_sql("LEFT"))
def join_left(spark, d):
    return joins.join_donations_projects(*_sides(spark, d), how="left")


@query(_join_sql("RIGHT"))
def join_right(spark, d):
    return joins.join_donations_projects(*_sides(spark, d), how="right")


@query(_join_sql("FULL"))
def join_full(spark, d):
    return joins.join_donations_projects(*_sides(spark, d), how="full", strategy="merge")


_RIGHT = "CASE WHEN p.project_id IS NULL THEN 'null|null|null|null' ELSE concat_ws('|', p.project_id, school_city, poverty_level, primary_focus_subject) END"


def _record_sql(fields: str, how: str) -> str:
    return f"""WITH {SIDES} SELECT CASE WHEN d.project_id IS NULL THEN 'null|null|null|null|null' ELSE concat_ws('|', donation_id, d.project_id, {fields}, printf('%.2f', total)) END AS "left", {_RIGHT} AS "right" FROM d {how} JOIN p ON d.project_id = p.project_id"""


@query(_record_sql("donor_city, ddate", "FULL"))
def join_records_city_date(spark, d):
    return joins.format_join_records(joins.join_donations_projects(*_sides(spark, d), how="full", strategy="merge"), "city_date")


@query(_record_sql("ddate, donor_city", "INNER"))
def join_records_text(spark, d):
    return joins.format_join_records(joins.join_donations_projects(*_sides(spark, d), strategy="shuffle_hash"), "date_city")


_SUBJECT = f"WHERE lower(primary_focus_subject) LIKE '%{SUBJECT}%'"


@query(_join_sql("INNER", _SUBJECT))
def join_subject_merge(spark, d):
    return joins.join_donations_projects(*_sides(spark, d), strategy="merge", subject=SUBJECT)


@query(_join_sql("INNER", _SUBJECT))
def join_subject_broadcast(spark, d):
    return joins.join_donations_projects(*_sides(spark, d), strategy="broadcast", subject=SUBJECT)


@query(_join_sql("INNER", _SUBJECT))
def join_bloom_merge(spark, d):
    return joins.join_donations_projects(*_sides(spark, d), strategy="merge", subject=SUBJECT, bloom=True)


@query(_join_sql("INNER", _SUBJECT))
def join_bloom_broadcast(spark, d):
    return joins.join_donations_projects(*_sides(spark, d), strategy="broadcast", subject=SUBJECT, bloom=True)


@query(_join_sql("INNER", _SUBJECT + " AND total >= 20000"))
def join_subject_min_total(spark, d):
    return joins.join_donations_projects(*_sides(spark, d), subject=SUBJECT, min_total=20_000)


#: Bits of the audit's filter: so few that it errs.
AUDIT_BITS, AUDIT_HASHES = 4096, 2


@query()
def bloom_audit(spark, d):
    """Every key that a small filter and the subject test judge differently."""
    p = adapters.projects(spark, d)
    has = E.subject_contains(F.col("primary_focus_subject"), SUBJECT)
    return bloom.bloom_audit(p, "project_id", has, bloom.bloom_build(p.filter(has), "project_id", AUDIT_BITS, AUDIT_HASHES))


@query(f"SELECT count(*) AS n, CAST(0 AS BIGINT) AS lost FROM part WHERE lower(p_name) LIKE '%{SUBJECT}%'")
def bloom_audit_fn(spark, d):
    """Members, and how many of them the small filter does not know."""
    p = adapters.projects(spark, d)
    has = E.subject_contains(F.col("primary_focus_subject"), SUBJECT)
    members = p.filter(has)
    known = bloom.bloom_probe(members, "project_id", bloom.bloom_build(members, "project_id", AUDIT_BITS, AUDIT_HASHES))
    return members.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~known, 1)).alias("lost"))


@query(_join_sql("INNER", _SUBJECT))
def join_bloom_saved(spark, d):
    """With a filter that was written and read again."""
    left, right = _sides(spark, d)
    path = scratch_path(spark, "bloom")
    bloom.bloom_save(spark, bloom.bloom_build(joins.with_subject(right, SUBJECT), "project_id"), path)
    return joins.join_donations_projects(left, right, strategy="merge", subject=SUBJECT, bloom=bloom.bloom_load(spark, path))


@query(_join_sql("INNER", _SUBJECT))
def join_bloom_approximate(spark, d):
    """The filter in place of the subject test; it is so large for its keys that no other key passes here."""
    left, right = _sides(spark, d)
    b = bloom.bloom_build(joins.with_subject(right, SUBJECT), "project_id", 32 * bloom.BITS, 11)
    return joins.join_donations_projects(left, right, strategy="merge", subject=SUBJECT, bloom=b, recheck=False)


_LAST = f"""WITH {DONATIONS}, l AS (SELECT CAST(p_size AS VARCHAR) AS project_id, arg_max(p_brand, p_partkey) AS school_city, arg_max(p_type, p_partkey) AS poverty_level, arg_max(p_name, p_partkey) AS primary_focus_subject FROM part GROUP BY 1)
SELECT l.project_id, donation_id, ddate, donor_city, total, school_city, poverty_level, primary_focus_subject, true AS has_donation, true AS has_project
FROM donations JOIN l ON CAST(CAST(amount AS BIGINT) AS VARCHAR) = l.project_id"""


@query(_LAST)
def join_last_project_wins(spark, d):
    """Many projects of one id, here their size, on the build side: the last one counts."""
    left = adapters.donations(spark, d).withColumn("project_id", F.col("amount").cast("long").cast("string"))
    right = adapters.projects(spark, d).withColumn("at", F.col("project_id").cast("long")).withColumn("project_id", F.col("p_size").cast("string"))
    return joins.join_donations_projects(left, right, strategy="broadcast", last_by_column="at")


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS project_id FROM part WHERE lower(p_name) LIKE '%{SUBJECT}%'")
def bloom_probe_members(spark, d):
    """Keys that pass the merged filter of two halves and the exact test."""
    p = adapters.projects(spark, d)
    has = E.subject_contains(F.col("primary_focus_subject"), SUBJECT)
    even = F.col("project_id").cast("long") % 2 == 0
    b = bloom.bloom_merge(bloom.bloom_build(p.filter(has & even), "project_id"), bloom.bloom_build(p.filter(has & ~even), "project_id"))
    return p.filter(bloom.bloom_probe(p, "project_id", b)).filter(has).select("project_id")


# words

LINES = "lines AS (SELECT unnest(string_split(text, chr(10))) AS value FROM documents)"
SPACED = "lower(regexp_replace(value, '[^a-zA-Z]', ' ', 'g'))"
COUNT = "SELECT word, count(*) AS count FROM w WHERE length(word) < 50 GROUP BY word"
CLEAN = f"WITH {LINES}, w AS (SELECT word FROM (SELECT unnest(string_split_regex({SPACED}, '\\s+')) AS word FROM lines) WHERE word <> '')"


@query(f"{CLEAN} {COUNT}")
def wordcount_clean(spark, d):
    return words.word_count(adapters.lines(spark, d), "clean")


@query(f"""WITH {LINES}, s AS (SELECT {SPACED} AS v FROM lines),
w AS (SELECT unnest(CASE WHEN v = '' THEN [''] WHEN rtrim(v) = '' THEN [] ELSE string_split_regex(rtrim(v), '\\s+') END) AS word FROM s) {COUNT}""")
def wordcount_java(spark, d):
    return words.word_count(adapters.lines(spark, d), "java")


@query(f"WITH {LINES}, w AS (SELECT unnest(string_split(lower(regexp_replace(value, '[^a-zA-Z]+', ' ', 'g')), ' ')) AS word FROM lines) {COUNT}")
def wordcount_python(spark, d):
    return words.word_count(adapters.lines(spark, d), "python")


@query(f"{CLEAN}, c AS ({COUNT}) SELECT word, count FROM c WHERE length(word) >= 3 AND count > 100 ORDER BY count DESC, word LIMIT 30")
def top_words_sql(spark, d):
    return words.top_words(words.word_count(adapters.lines(spark, d), "clean"), min_count=100)


@query(f"{CLEAN}, c AS ({COUNT}) SELECT word || ' ' || count AS line FROM c")
def wordcount_lines(spark, d):
    """Counts as the lines that the one-file sink writes."""
    return words.word_count(adapters.lines(spark, d), "clean").select(F.concat_ws(" ", "word", F.col("count").cast("string")).alias("line"))


# posts


@query("SELECT count(*) AS n FROM events")
def posts_count(spark, d):
    return posts.posts_count(adapters.posts(spark, d))


_POSTS = f"SELECT CAST(user_id AS VARCHAR) AS username, ts AS creation, props AS content FROM events WHERE user_id = {USER}"


@query(f"{_POSTS} ORDER BY ts LIMIT 5")
def posts_user_oldest_n(spark, d):
    return posts.user_posts(adapters.posts(spark, d), USER, 5)


@query(f"{_POSTS} ORDER BY ts DESC LIMIT 5")
def posts_user_latest_n(spark, d):
    return posts.user_posts(adapters.posts(spark, d), USER, 5, latest=True)


@query(f"SELECT *, date_trunc('millisecond', creation) AS creation_date, row_number() OVER (ORDER BY creation DESC) AS rank FROM ({_POSTS})")
def posts_user_desc(spark, d):
    from pyspark.sql import Window

    rows = posts.user_posts_with_date(adapters.posts(spark, d), USER)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("username").orderBy(F.desc("creation"))))


# views and parsing


@query(f"""WITH {DONATIONS}, f AS (SELECT *, l_linestatus AS payment_method FROM donations)
SELECT donation_id, project_id, donor_city, donor_state, donor_is_teacher, ddate, amount, support, total, payment_method,
       CASE WHEN l_linenumber = 1 THEN 't' ELSE 'f' END AS payment_inc_acct_credit, CASE WHEN l_linenumber = 2 THEN 't' ELSE 'f' END AS payment_inc_campaign_gift_card,
       CASE WHEN l_linenumber = 3 THEN 't' ELSE 'f' END AS payment_inc_web_gift_card, CASE WHEN l_linenumber = 4 THEN 't' ELSE 'f' END AS payment_promo_matched,
       CASE WHEN l_linenumber = 5 THEN 't' ELSE 'f' END AS via_giving_page, CASE WHEN l_linenumber = 7 THEN 't' ELSE 'f' END AS thank_you_packet, l_returnflag AS message
FROM f""")
def compat_view_17(spark, d):
    return readers.compat_view(adapters.donations(spark, d))


def raw_lines(spark: SparkSession, d: str) -> DataFrame:
    """CSV lines with inner quotes, escaped commas, bad numbers and, for every tenth part, too few fields."""
    p = adapters.table(spark, d, "part")
    t = lambda c: F.col(c).cast("string")
    fields = [t("p_partkey"), F.concat(F.lit('"P'), t("p_size"), F.lit('"')), F.lit("donor"), F.lit("cart"), F.concat(F.lit('"'), F.col("p_brand"), F.lit('"')), F.col("p_type"), F.lit("zip"), F.when(F.col("p_size") % 3 == 0, "t").otherwise("f"), F.lit("2010-01-02 03:04:05.6"), F.when(F.col("p_size") % 7 == 0, "abc").otherwise(t("p_size")), F.lit(""), F.when(F.col("p_size") % 5 == 0, "1e3").otherwise(t("p_size"))]
    fields += [F.lit("c12"), F.lit("c13")] + [F.lit(x) for x in ("card", "f", "f", "t", "f", "t", "f", "t")]
    short = F.concat_ws(",", *fields)
    return p.select(F.when(F.col("p_partkey") % 10 == 0, short).otherwise(F.concat(short, F.lit(',"thanks\\, a ""lot"" '), F.col("p_name"), F.lit('"'))).alias("value"))


_RAW = """r AS (SELECT replace(concat_ws(',', p_partkey, '"P' || p_size || '"', 'donor', 'cart', '"' || p_brand || '"', p_type, 'zip', CASE WHEN p_size % 3 = 0 THEN 't' ELSE 'f' END, '2010-01-02 03:04:05.6',
  CASE WHEN p_size % 7 = 0 THEN 'abc' ELSE CAST(p_size AS VARCHAR) END, '', CASE WHEN p_size % 5 = 0 THEN '1e3' ELSE CAST(p_size AS VARCHAR) END, 'c12', 'c13', 'card', 'f', 'f', 't', 'f', 't', 'f', 't')
  || CASE WHEN p_partkey % 10 = 0 THEN '' ELSE ',"thanks\\, a ""lot"" ' || p_name || '"' END, '"', '') AS v FROM part),
s AS (SELECT string_split(replace(v, '\\,', chr(1)), ',') AS p FROM r),
t AS (SELECT list_transform(p, lambda x: replace(x, chr(1), '\\,')) AS p FROM s)"""


@query(f"""WITH {_RAW} SELECT p[1] AS donation_id, p[2] AS project_id, p[5] AS donor_city, p[6] AS donor_state, p[8] AS donor_is_teacher, p[9] AS ddate,
  coalesce(TRY_CAST(p[10] AS FLOAT), 0) AS amount, coalesce(TRY_CAST(p[11] AS FLOAT), 0) AS support, coalesce(TRY_CAST(p[12] AS FLOAT), 0) AS total, p[15] AS payment_method,
  p[16] AS payment_inc_acct_credit, p[17] AS payment_inc_campaign_gift_card, p[18] AS payment_inc_web_gift_card, p[19] AS payment_promo_matched, p[20] AS via_giving_page,
  p[21] AS for_honoree, p[22] AS thank_you_packet, p[23] AS message FROM t WHERE len(p) >= 23""")
def csv_parse_expr(spark, d):
    return readers.parse_donations(raw_lines(spark, d))


@query(f"WITH {_RAW} SELECT count(*) AS processed, count(*) FILTER (len(p) < 23) AS errors FROM t")
def csv_parse_counters(spark, d):
    parts = raw_lines(spark, d).select(F.size(E.csv_parts(F.col("value"))).alias("n"))
    return parts.agg(F.count(F.lit(1)).alias("processed"), F.count(F.when(F.col("n") < schemas.DONATION_RAW_COLUMNS, 1)).alias("errors"))


@query(f"WITH {DONATIONS} SELECT donation_id || '|project=' || project_id || '|city=' || donor_city || '|total=' || printf('%.2f', total) AS value FROM donations")
def donation_lines(spark, d):
    return readers.describe_donations(adapters.donations(spark, d))


# sources and sinks: what is written to the shared folder and read again


def _headed(lines: DataFrame, header: str) -> DataFrame:
    """``lines`` with the header before each partition's, so that each file begins with one."""

    def run(batches):
        import pyarrow as pa

        for i, b in enumerate(batches):
            if not i:
                yield pa.record_batch([pa.array([header], b.schema.field(0).type)], schema=b.schema)
            yield b

    return lines.select("value").mapInArrow(run, "value string")


def _csv_files(spark: SparkSession, lines: DataFrame, names: list[str], width: int) -> str:
    path, header = scratch_path(spark, "csv"), ",".join([*names, *(f"raw{i}" for i in range(width - len(names)))])
    _headed(lines, header).write.text(path)
    return path


def _donations_ingest(spark: SparkSession, d: str) -> readers.Ingest:
    path = _csv_files(spark, raw_lines(spark, d), [n for n, _, _ in schemas.DONATION_FIELDS], schemas.DONATION_RAW_COLUMNS)
    return readers.read_donations_csv(spark, path)


@query(_SQL["csv_parse_expr"])
def csv_ingest_donations(spark, d):
    return _donations_ingest(spark, d).rows


@query(f"WITH {_RAW} SELECT CAST(count(*) FILTER (len(p) < 23) AS BIGINT) AS rejects, CAST(count(*) FILTER (len(p) < 23) AS BIGINT) AS errors, count(*) FILTER (len(p) >= 23) AS n FROM t")
def csv_ingest_counters(spark, d):
    """Lines put aside, lines counted as errors, and rows."""
    got = _donations_ingest(spark, d)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(got.rejects, "rejects").join(F.broadcast(got.metrics.select("errors")), F.lit(True)).join(F.broadcast(count(got.rows, "n")), F.lit(True))


def _raw_project(i: int, kind: str) -> str:
    """SQL of the i-th raw field of a project's line; every seventh part has bad numbers."""
    if kind == "float":
        return f"CASE WHEN p_size % 7 = 0 THEN 'abc' ELSE CAST(p_size + {i} AS STRING) || '.25' END"
    if kind == "int":
        return "CASE WHEN p_size % 7 = 0 THEN '12.5' WHEN p_size % 5 = 0 THEN '+5' ELSE CAST(p_size AS STRING) END"
    return f"'v{i}-' || CAST(p_partkey AS STRING)"


def project_lines(spark: SparkSession, d: str) -> DataFrame:
    kinds = {i: kind for _, i, kind in schemas.PROJECT_FIELDS}
    fields = [_raw_project(i, kinds.get(i, "string")) for i in range(schemas.PROJECT_RAW_COLUMNS)]
    return adapters.table(spark, d, "part").selectExpr(f"concat_ws(',', {', '.join(fields)}) AS value")


_NUMBER = {"float": "coalesce(TRY_CAST(x AS FLOAT), 0)", "int": "CASE WHEN regexp_full_match(x, '[+-]?[0-9]+') THEN CAST(x AS INTEGER) ELSE 0 END", "string": "x"}
_PROJECT_COLUMNS = {n: _NUMBER[kind].replace("x", f"({_raw_project(i, kind)})") if kind == "string" else re.sub(r"\bx\b", lambda _, e=_raw_project(i, kind): f"({e})", _NUMBER[kind]) for n, i, kind in schemas.PROJECT_FIELDS}
_PROJECT_SQL = f"SELECT {', '.join(f'{e} AS {n}' for n, e in _PROJECT_COLUMNS.items())} FROM part"


@query(_PROJECT_SQL)
def csv_ingest_projects(spark, d):
    names = [n for n, _, _ in schemas.PROJECT_FIELDS]
    return readers.read_projects_csv(spark, _csv_files(spark, project_lines(spark, d), names, schemas.PROJECT_RAW_COLUMNS)).rows


@query(f"SELECT {', '.join(f'{n} AS c{i}' for i, n in enumerate(_PROJECT_COLUMNS))} FROM ({_PROJECT_SQL})")
def projects_view_30(spark, d):
    return readers.projects_view(readers.parse_projects(project_lines(spark, d)), [f"c{i}" for i in range(30)])


@query(f"SELECT project_id || '|school=' || school_id || '|total_amount=' || CAST(total_price_including_opt_donation AS VARCHAR) || '|status=' || funding_status AS value FROM ({_PROJECT_SQL})")
def project_display_lines(spark, d):
    return readers.describe_projects(readers.parse_projects(project_lines(spark, d)))


@query("SELECT o_orderpriority AS key, CAST(o_orderkey AS VARCHAR) AS value FROM orders")
def kv_text_round_trip(spark, d):
    path = scratch_path(spark, "kv")
    sinks.write_kv_text(adapters.table(spark, d, "orders"), path, "o_orderpriority", "o_orderkey")
    return readers.read_kv_text(spark, path)


@query("SELECT CAST(1 AS BIGINT) AS files, count(*) AS n FROM nation")
def kv_text_in_one_file(spark, d):
    path = scratch_path(spark, "kv-one")
    sinks.write_kv_text(adapters.table(spark, d, "nation"), path, "n_nationkey", "n_name", files=1)
    return readers.read_kv_text(spark, path).withColumn("file", F.input_file_name()).agg(F.countDistinct("file").alias("files"), F.count(F.lit(1)).alias("n"))


@query(_SQL["compat_view_17"])
def table_round_trip(spark, d):
    path = scratch_path(spark, "table")
    sinks.write_table(readers.compat_view(adapters.donations(spark, d)), path)
    return readers.read_table(spark, path)


@query(f"{CLEAN} {COUNT}")
def wordcount_text_files(spark, d):
    path = scratch_path(spark, "text")
    adapters.lines(spark, d).filter("value is not null").write.text(path)
    return words.word_count(readers.read_lines(spark, path), "clean")


@query(f"{CLEAN}, c AS ({COUNT}) SELECT '(' || word || ',' || count || ')' AS value FROM c")
def wordcount_tuples(spark, d):
    path = scratch_path(spark, "tuples")
    sinks.write_tuples(words.word_count(adapters.lines(spark, d), "clean"), path)
    return readers.read_lines(spark, path)


@query(f"{CLEAN}, c AS ({COUNT}) SELECT word || ' ' || count AS value FROM c")
def wordcount_one_ordered_file(spark, d):
    path = scratch_path(spark, "counts")
    sinks.write_counts_file(words.word_count(adapters.lines(spark, d), "clean"), path, ordered=True)
    return readers.read_lines(spark, path)


@query(_SQL["top_words_sql"])
def top_words_pandas(spark, d):
    return spark.createDataFrame(sinks.to_pandas(top_words_sql(spark, d), 30), "word string, count long")


@query(_SQL["compat_view_17"])
def registered_views(spark, d):
    readers.register_views(spark, adapters.donations(spark, d), readers.parse_projects(project_lines(spark, d)))
    return spark.sql("select * from donations_compat")


_UUID = """SELECT CAST(user_id AS VARCHAR) AS username, ts, props AS content, format('{:015x}', epoch_us(ts) * 10 + 122192928000000000) AS t FROM events"""


@query(f"""SELECT username, content, substr(t, 8, 8) || '-' || substr(t, 4, 4) || '-1' || substr(t, 1, 3) AS time, epoch_us(date_trunc('millisecond', ts)) AS creation_us FROM ({_UUID}) WHERE username = '{USER}'""")
def posts_time_uuid(spark, d):
    """Posts with time UUIDs, appended to a table in two parts and read again."""
    path, rows = scratch_path(spark, "posts"), adapters.uuid_posts(spark, d)
    first = F.crc32("content") % 2 == 0
    sinks.append_posts(rows.filter(first), path)
    sinks.append_posts(rows.filter(~first), path)
    return posts.user_posts_with_date(readers.read_table(spark, path), USER).select("username", "content", F.substring("creation", 1, 18).alias("time"), F.unix_micros("creation_date").alias("creation_us"))


@query(f"WITH {DONATIONS} SELECT DISTINCT lower(donor_state) AS state, CAST(1 AS BIGINT) AS partitions FROM donations")
def natural_key_partitioner(spark, d):
    """In how many partitions a state's rows lie."""
    rows = sorts.natural_key_partitions(adapters.donations(spark, d), 7)
    return rows.withColumn("at", F.spark_partition_id()).groupBy(F.lower("donor_state").alias("state")).agg(F.countDistinct("at").alias("partitions"))


@query(f"WITH {DONATIONS} SELECT CAST(least(500, count(*)) AS BIGINT) AS n, true AS known FROM donations")
def sample_keys_content(spark, d):
    """Sampled keys, and whether all of them are in the table."""
    rows = adapters.donations(spark, d)
    every = rows.select(F.col("donor_state").alias("state"), F.col("donor_city").alias("city"), "total", F.lit(True).alias("there")).dropDuplicates()
    got = F.broadcast(sorts.sample_keys(rows, 500, seed=7).withColumn("i", F.monotonically_increasing_id()))
    return got.join(every, ["state", "city", "total"]).agg(F.countDistinct("i").alias("n"), F.bool_and("there").alias("known"))


@query("SELECT p_partkey, CASE WHEN strpos(p_name, ' ') > 0 THEN substr(p_name, strpos(p_name, ' ') + 1) ELSE '' END AS rest FROM part")
def substring_after_space(spark, d):
    return adapters.table(spark, d, "part").select("p_partkey", E.substring_after(F.col("p_name"), " ").alias("rest"))


_ODD = "CASE p_size % 7 WHEN 0 THEN 'abc' WHEN 1 THEN '' WHEN 2 THEN ' 5 ' WHEN 3 THEN '12.5' WHEN 4 THEN '+5' WHEN 5 THEN '99999999999' ELSE CAST(p_size AS STRING) END"


@query(f"""SELECT p_partkey, coalesce(TRY_CAST(v AS FLOAT), 0) AS f, CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN coalesce(TRY_CAST(v AS INTEGER), 0) ELSE 0 END AS i, p_size % 3 = 0 AS b
FROM (SELECT *, {_ODD} AS v FROM part)""")
def lenient_values(spark, d):
    t = adapters.table(spark, d, "part").selectExpr("p_partkey", f"{_ODD} AS v", "CASE p_size % 3 WHEN 0 THEN 't' WHEN 1 THEN 'f' END AS t")
    return t.select("p_partkey", E.float_or_zero(F.col("v")).alias("f"), E.strict_int(F.col("v")).alias("i"), E.parse_boolean(F.col("t")).alias("b"))


@query("SELECT DISTINCT o_orderpriority AS key, CAST(1 AS BIGINT) AS buckets, true AS within FROM orders")
def hash_buckets(spark, d):
    """How many buckets a key falls into, and whether they are in range."""
    b = E.hash_bucket(F.col("o_orderpriority"), 3)
    return adapters.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("key")).agg(F.countDistinct(b).alias("buckets"), F.bool_and((b >= 0) & (b < 3)).alias("within"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
