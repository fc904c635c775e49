"""Every query that has SQL gives the rows that DuckDB gives, with equal columns and types."""

import math
import os

import duckdb
import pytest

from veridix.plans.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


def norm(v):
    return None if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    out = db.execute(ORACLE[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(dict(zip(names, r, strict=True))[c]) for c in cols) for r in out.fetchall()), key=str)
    assert got == want


def test_titles_that_end_within_a_reference(spark, tmp_path):
    titles = ["a &amp; b &amp", "a &quot", "&lt;b&gt &am", "&eacute; &#233; &amp;lt;", "plain"]
    rows = [(i, f"<title>{t}</title>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in QUERIES["unescaped_pages"](spark, str(tmp_path)).collect())
    assert got == sorted(duckdb.sql(ORACLE["unescaped_pages"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall())
