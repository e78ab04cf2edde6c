"""Pages whose titles hold other references than the small tables' titles, and several addresses, against the queries' SQL."""

import duckdb
import pytest

from tessera.functions import markup
from tessera.plans import evidence
from tessera.plans import queries as plans

#: More references than the SQL decodes in a title, so its length differs as well.
TITLE = "A &quot;token&quot; &lt;b&gt; &amp;amp; &#233;&#65; &apos;x&apos;"
PAGES = [
    (0, "https://a.example/", f"<title>{TITLE}</title>"), (1, "https://b.example/", "<title>&quot;</title><p>one@a.example two@b.example</p>"), (3, "https://c.example/", "<title> x </title><p>one@a.example</p>"),
    (5, "https://d.example/", f"<title>{'y' * 58}&quot;&#39;</title>"),
]


@pytest.mark.parametrize("name", ["page_head", "seo_checks", "seo_score", "page_scans"])
def test_same_rows(spark, tmp_path, name):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    query, sql = (plans.QUERIES | evidence.QUERIES)[name], (plans.SQL | evidence.SQL)[name]
    df, found = query(spark, str(tmp_path)), con.execute(sql)
    names = [d[0] for d in found.description]
    want = [tuple(x[names.index(c)] for c in df.columns) for x in found.fetchall()]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


def test_the_library_decodes_all_references(spark):
    df = spark.createDataFrame([(f"<title>{TITLE}</title>",)], "html string")
    assert df.select(markup.title(df.html)).first()[0] == "A \"token\" <b> &amp; éA 'x'"
