from pyspark.sql import functions as F

from almoner import schemas
from almoner.functions import expressions as E
from almoner.sources import readers, sinks


def one(spark, expr, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(expr(F.col("v"))).collect()]


def test_split_removes_quotes_and_keeps_escapes_and_empties(spark):
    assert one(spark, E.csv_parts, '"i","a, b",,"q""z"', r"a\, b,c,,", "") == [["i", "a", " b", "", "qz"], [r"a\, b", "c", "", ""], [""]]


def test_numbers(spark):
    assert one(spark, E.float_or_zero, "abc", "", "1e3", "47.5", None) == [0.0, 0.0, 1000.0, 47.5, 0.0]
    assert one(spark, E.strict_int, " 5 ", "12.5", "+5", "-7", "x", "", None, "99999999999") == [0, 0, 5, -7, 0, 0, 0, 0]


def test_text_helpers(spark):
    assert one(spark, lambda c: E.substring_after(c, ":"), "a:b:c", "abc", ":x") == ["b:c", "", "x"]
    assert one(spark, E.parse_boolean, "t", "f", "", None) == [True, False, False, False]
    assert one(spark, lambda c: E.subject_contains(c, "science"), "Health & Life SCIENCE", "Math", None, "") == [True, False, False, False]
    assert one(spark, E.two_decimals, "0.125", None) == ["0.13", "null"]


def write(tmp_path, name, lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def donation(i, city="Springfield", state="CA", teacher="f", total="10.00", message="thanks"):
    f = [f"d{i}", f"p{i}", "donor", "cart", city, state, "zip", teacher, "2011-01-02", "8.50", "1.50", total, "cat", "t", "card", "f", "f", "f", "f", "f", "t", "f", message]
    return ",".join(f'"{x}"' for x in f)


def test_read_donations(spark, tmp_path):
    header = ",".join(f"c{i}" for i in range(23))
    lines = [header, donation(1), donation(2, message=r"share\, please"), donation(3, total="abc"), donation(4) + ",extra", ",".join(donation(5).split(",")[:22]), donation(6, message='a ""b"" c')]
    got = readers.read_donations_csv(spark, write(tmp_path, "d.csv", lines))
    rows = {r.donation_id: r for r in got.rows.collect()}
    assert got.rows.columns == schemas.DONATIONS.names
    assert sorted(rows) == ["d1", "d2", "d3", "d4", "d6"]
    assert rows["d2"].message == r"share\, please" and rows["d3"].total == 0.0 and rows["d6"].message == "a b c" and rows["d1"].for_honoree == "t"
    assert got.rejects.count() == 1 and got.metrics.first().asDict() == {"processed": 7, "errors": 1}


def test_unescaped_comma_shifts_columns(spark, tmp_path):
    got = readers.read_donations_csv(spark, write(tmp_path, "d.csv", ["h", donation(1, city="a, b")]))
    assert got.rows.first().donor_state == " b"


def test_read_projects(spark, tmp_path):
    f = [f"v{i}" for i in range(44)]
    f[28:37] = ["1.5", "x", "", "2", "3", "4", "251.50", "7", "+2"]
    got = readers.read_projects_csv(spark, write(tmp_path, "p.csv", ["h", ",".join(f)])).rows.first()
    assert (got.project_id, got.school_country, got.vendor_shipping_charges, got.sales_tax, got.students_reached, got.total_donations, got.num_donors, got.date_expiration) == ("v0", "v11", 1.5, 0.0, 0, 7, 2, "v43")


def test_round_trips(spark, tmp_path):
    df = readers.parse_donations(spark.createDataFrame([(donation(1),)], "value string"))
    sinks.write_table(df, str(tmp_path / "t"))
    assert readers.read_table(spark, str(tmp_path / "t"), schemas.DONATIONS).collect() == df.collect()
    pairs = spark.createDataFrame([("a\tx", 1.5), ("b", 2.0)], "key string, value double")
    sinks.write_kv_text(pairs, str(tmp_path / "kv"), "key", "value", files=1)
    assert sorted(map(tuple, readers.read_kv_text(spark, str(tmp_path / "kv")).collect())) == [("a", "x\t1.5"), ("b", "2.0")]
    counts = spark.createDataFrame([("b", 2), ("a", 1)], "word string, count long")
    sinks.write_counts_file(counts, str(tmp_path / "c"), ordered=True)
    sinks.write_tuples(counts, str(tmp_path / "u"))
    assert [r.value for r in spark.read.text(str(tmp_path / "c")).collect()] == ["a 1", "b 2"]
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "u")).collect()) == ["(a,1)", "(b,2)"]
    assert len(sinks.to_pandas(counts, 1)) == 1


def test_views(spark):
    d = readers.parse_donations(spark.createDataFrame([(donation(1),)], "value string"))
    p = spark.createDataFrame([], schemas.PROJECTS)
    readers.register_views(spark, d, p)
    assert len(spark.table("donations_compat").columns) == 17 and "for_honoree" not in spark.table("donations_compat").columns
    assert readers.compat_view(d, [f"x{i}" for i in range(17)]).columns[0] == "x0"
    try:
        readers.compat_view(d, ["x"])
        raise AssertionError("a wrong number of names must fail")
    except ValueError:
        pass
    assert len(readers.projects_view(p).columns) == 30
    assert readers.describe_donations(d).first().value == "d1|project=p1|city=Springfield|total=10.00"
    assert readers.describe_projects(p).count() == 0
