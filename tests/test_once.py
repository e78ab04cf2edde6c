"""What a page costs: each of its parts is computed once, and patterns without a mark are few."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import markup, matcher
from tessera.operators import correlate, hosts, scoring
from tessera.registry import ACCOUNT_IDS, FORM_ENDPOINTS, FORM_MARK, literal
from tessera.sources import tables


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, "a.example", "<body><div id='x'></div></body>"), (2, "b.example", None), (3, "c.example", "")], "page_id long, host string, html string")


def times(df, text):
    return df._jdf.queryExecution().analyzed().toString().count(text)


def test_a_page_s_body_is_read_once(pages):
    assert times(pages.select(markup.body_hash(F.col("html")).alias("x")), "<body[") == 1
    assert times(pages.select(hosts.page_signals(F.col("html")).alias("x")), "<body[") == 1


def test_inline_scripts_are_read_once(pages):
    none = F.array().cast("array<struct<src:string,network:string,adult:boolean>>")
    df = pages.select(scoring._inline(F.col("html"), none).alias("x"))
    assert times(df, "<script(?![") == 1
    script = pages.select(scoring._inline(F.lit("<script>a('exoclick.com/x')</script>"), none).alias("x")).first().x
    assert [tuple(x) for x in script] == [("(inline)", "ExoClick", True)] and all(not r.x for r in df.collect())


def test_the_visible_text_is_read_once(pages):
    assert times(scoring.content_signals(pages), "(?i)&[a-z]+;") == 1


def test_marks_stand_in_groups_too():
    assert [literal(p) for p in ("(?:^|[^a])(6L[a-z]{38})(?:[^a]|$)", "(ab)?c", "(ab)+c", "x(?=bcd)", "(a|bcd)e", "((?:a|b)cde)f", r"(a\(b)c")] == ["6L", "c", "ab", "x", "e", "cdef", "a(bc"]
    assert all(literal(p) for _, p in ACCOUNT_IDS)


def test_no_empty_single_signals(spark):
    df = spark.createDataFrame([("x",), ("",), (None,)], "v string")
    assert [r.x for r in df.select(hosts._one(F.col("v")).alias("x")).collect()] == [["x"], [], []]


def test_pairs_tell_the_number_of_tasks(spark):
    own = spark.range(40).selectExpr("id AS s").crossJoin(spark.range(3).selectExpr("id AS p")).unionByName(spark.sql("SELECT 99L AS s, CAST(null AS BIGINT) AS p"))
    met = correlate.shared_counts(own, "s", "p", task_pairs=100)
    assert met.rdd.getNumPartitions() == 24  # 3 * 780 pairs
    rows = met.collect()
    assert len(rows) == 780 and all(r.a < r.b and r.n == 3 for r in rows)
    assert correlate.shared_counts(own.limit(0), "s", "p").count() == 0


def test_pairs_are_added_up_where_they_are_made(spark):
    own = spark.range(5000).selectExpr("id % 71 AS s", "id * 7 % 501 AS p")
    plan = correlate.shared_counts(own, "s", "p")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"a#\d+L? < b#", plan) and "Exchange" not in plan[: re.search(r"a#\d+L? < b#", plan).start()]  # nothing is shuffled above the pairs


@pytest.mark.parametrize("made", [lambda i: i - 50, lambda i: f"o{i}"])
def test_pairs_of_hubs_and_repeats(spark, made):
    rows = [(made(s), p) for p in range(60) for s in (0, 50, 99, *((p * 13 + k * k * 7) % 100 for k in range(p % 9)))] * 2  # three owners have all keys
    rows += [(made(i), 999) for i in range(100)] + [(made(7), 1000), (None, 1), (made(3), None)]
    held = {}
    for s, p in rows:
        if s is not None and p is not None:
            held.setdefault(p, set()).add(s)
    want = Counter((a, b) for owners in held.values() for a in owners for b in owners if a < b)
    own = spark.createDataFrame(rows, f"s {'string' if isinstance(made(0), str) else 'long'}, p long")
    for task_pairs in (40, 10**6):
        rows = correlate.shared_counts(own, "s", "p", task_pairs).withColumn("part", F.spark_partition_id()).collect()
        assert {(r.a, r.b): r.n for r in rows} == want and len(rows) == len(want)
        assert task_pairs > 40 or max(Counter(r.part for r in rows).values()) <= 160  # a hub's pairs are made by several tasks


def test_any_letter_is_a_dot_for_java(spark, pages):
    html = "<head>a\n\u2028<p></head><body class='x'>\r\n<div id='\U0001f600'>\u0085<!-- a\nb --><script>\n1</script></div></BODY>"
    df = spark.createDataFrame([(1, "a.example", html)], "page_id long, host string, html string")
    old = [F.regexp_extract("html", p, 1) for p in (r"(?i)<head[^>]*>([\s\S]*?)</head>", r"(?i)<body[^>]*>([\s\S]*?)</body>")]
    new = [F.regexp_extract("html", p.replace(r"[\s\S]", "(?s:.)"), 1) for p in (r"(?i)<head[^>]*>([\s\S]*?)</head>", r"(?i)<body[^>]*>([\s\S]*?)</body>")]
    row = df.select(*[x.alias(f"c{k}") for k, x in enumerate(old + new)]).first()
    assert row.c0 == row.c2 == "a\n\u2028<p>" and row.c1 == row.c3 != ""
    assert times(pages.select(hosts.page_signals(F.col("html")).alias("x")), r"[\s\S]") == 0


def test_marks_are_looked_for_at_once(spark, pages):
    rules = [("category", 1), ("cat", 2), ("atego", 3), ("(?i)x-cat", 4), ("idsite=", 5)]
    df = spark.createDataFrame([("a X-CATEGORY",), ("gory cat",), ("idsite=",), ("dsite",)], "text string")
    found = sorted((r.text, r.n) for r in matcher.tried(df, "text", rules, "pattern string, n int").collect())
    assert found == [("a X-CATEGORY", n) for n in (1, 2, 3, 4)] + [("gory cat", 2), ("idsite=", 5)]
    assert times(matcher.tried(df, "text", rules, "pattern string, n int"), "lower(text") == 0


def test_every_form_endpoint_holds_the_mark(spark):
    hosts_ = ("formspree.io/f/a1", "formsubmit.co/x", "getform.io/x", "x.typeform.com/x", "app.Netlify.x", "basin.io/f", "fabform.io/f", "calendly.com/x", "tally.so/x")
    texts = [f"{name}='https://{h}'" for h in hosts_ for name in ("action", "src", "href", "data-url")] + ['"https://formspree.io/f/a1"', '"https://calendly.com/x"']
    held = [t for t in texts if any(re.search(p, t) for p in FORM_ENDPOINTS)]
    df = spark.createDataFrame([(t,) for t in held] + [(t.upper(),) for t in held], "text string")
    assert len(held) == 17 and df.where(F.col("text").rlike(FORM_MARK)).count() == 34


def test_addresses_are_looked_for_behind_a_domain_only(spark):
    rows = [("x <b>A.b@c.example</b> @d.example e@f e@.f <i@j.example> k@l.<m>n</m>",), ("none @ all",), ("<a href='mailto:Q@r.example'>",)]
    got = [r.x for r in spark.createDataFrame(rows, "html string").select(markup.emails(F.col("html")).alias("x")).collect()]
    assert got == [["a.b@c.example"], [], ["q@r.example"]]


def test_one_row_group_is_dealt_out(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(400).selectExpr("id AS page_id", "concat_ws('', transform(sequence(1, 100), x -> sha2(concat(id, ' ', x), 512))) AS html").coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() > 4  # of which one has all rows
        rows = tables.spread(df).groupBy(F.spark_partition_id()).count().collect()
        assert len(rows) > 4 and sum(r["count"] for r in rows) == 400
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    even = spark.range(0, 400, 1, 4)
    assert tables.spread(even) is even and tables.spread(even.limit(0)).count() == 0
