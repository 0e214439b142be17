"""Every listing query runs on the smallest tables, and agrees with its SQL."""

import math
import os

import duckdb
import pytest

from lotwise import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return None if v is None else repr(v + 0.0) if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_agrees_with_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted(str([plain(v) for v in r]) for r in df.select(*columns).collect())
    assert got == sorted(str([plain(r[i]) for i in at]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_outline_of_references_without_semicolon(spark, tmp_path):
    """A title cut after its escape ends in `&amp`, which is read as the sign; so does the SQL."""
    html = "<html><title>a&amp;&amp</title><h1>&quotb&quot &amp;quot;</h1><p>x &copy y</p><footer>&copy; z&amp</footer></html>"
    spark.createDataFrame([(1, html)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.page_outline(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.sql(queries.ORACLE_SQL["page_outline"]).select(*got.columns).fetchall()
    assert [tuple(r) for r in got.collect()] == want and want[0][1] == "a&&"
