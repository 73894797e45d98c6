"""Every registered query of the star schema against DuckDB, on the smallest tables."""

import os

import pytest

from almoner.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def rows(df):
    names = sorted(df.columns)
    clean = lambda v: None if v is None or v != v else str(v) if not isinstance(v, (int, float)) else v
    return sorted((tuple(clean(v) for v in r) for r in df[names].astype(object).itertuples(index=False)), key=repr)


def test_every_query_has_sql():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"bloom_audit"}


def test_the_audit_finds_the_false_positives(spark, duck):
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    at = lambda key: {signed(xxhash.xxh64(i.to_bytes(4, "little"), seed=xxhash.xxh64(key.encode(), seed=42).intdigest()).intdigest()) % catalog.AUDIT_BITS for i in range(catalog.AUDIT_HASHES)}
    rows = duck.sql("select cast(p_partkey as varchar), lower(p_name) like '%widget%' from part").fetchall()
    bits = set().union(*(at(k) for k, has in rows if has))
    want = sorted(("FALSE_POSITIVE", k) for k, has in rows if not has and at(k) <= bits)
    assert sorted(map(tuple, catalog.queries()["bloom_audit"](spark, SF).collect())) == want


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_duckdb(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
