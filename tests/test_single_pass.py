"""Signals of hosts: a page is gone through once, and what its cheap searches find is what the patterns find."""

import random

from pyspark.sql import functions as F

from tessera.functions import markup, matcher
from tessera.operators import hosts, identifiers
from tessera.registry import ACCOUNT_IDS


def test_pages_are_read_once_for_signals(spark, tmp_path):
    rows = [(k, f"h{k % 3}.example", f"<body><b src='/umami.js' data-website-id='0123456{k % 2}-89ab-cdef-0123-456789abcdef'>GTM-ABCD{k % 4}</body>") for k in range(12)]
    spark.createDataFrame(rows, "page_id long, host string, html string").write.parquet(str(tmp_path / "pages"))
    found = hosts.signals(spark.read.parquet(str(tmp_path / "pages")))
    assert str(tmp_path) not in found._jdf.queryExecution().executedPlan().toString() and "html" not in found._jdf.queryExecution().analyzed().toString()
    assert {(r.domain, r.kind, r.times) for r in found.collect()} >= {("h0.example", "umami_src", 2), ("h1.example", "umami_id", 2)}


def test_leads_with_a_rare_second_letter_are_all_found(spark):
    dice = random.Random(5)
    leads = {"a-", "b-a", "b-ab", "--", "c.a"}
    texts = ["".join(dice.choices("abcAB.-\n\U0001f600", k=dice.randrange(14))) for _ in range(400)] + ["", "-", "a-", "-a"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string").withColumn("found", matcher.pairs_in(F.col("text"), leads))
    for r in df.collect():
        at = [max((x for x in leads if r.text.lower().startswith(x, k)), key=len, default=None) for k in range(len(r.text))]
        assert {x.lower() for x in r.found} == {x for x in at if x}


def test_a_lead_is_held_by_each_match(spark):
    for _, p in ACCOUNT_IDS:
        assert matcher.rare_lead(p) in p.lower().replace("\\", "")
    samples = [("Sentry Org", "https://0123456789abcdef@o123.ingest.sentry.io/1"), ("Matomo Site ID", "setSiteId', 3"), ("reCAPTCHA Site Key", " 6L" + "a" * 38), ("Yandex Metrika", "ym(1234567, 'init'"), ("Hotjar", "HOTJAR.COM"), ("Microsoft Clarity", "CLARITY.MS/TAG/x")]
    rows = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(samples)], "page_id int, html string")
    assert {(samples[r.page_id][0], r["name"]) for r in identifiers.account_ids(rows).collect()} == {(n, n) for n, _ in samples if n != "Hotjar"} | {("Sentry Org", "Sentry DSN")}


def test_gates_of_signals_lose_nothing(spark):
    pieces = ["MAILTO:A@b.example?x", "mailto:z", " c@d.example ", "URL('f/a.woff2')", "url(b.ttf)", "<script type='application/LD+JSON'>{\"sameAs\":[\"u\"]}</script>", "<style>p{color:red;}</style>", "<!-- <div> note -->", "<SCRIPT>var longer = 1;</SCRIPT>", "<div class='a' id=\"b\">", "<nav>", "</style>", "<body x>", "</BODY>", "<meta name='generator' content='G'>", '<meta name="twitter:site" content="@t">', "<sec<!-- x -->tion>"]
    dice = random.Random(6)
    pages = [(k, "".join(dice.choices(pieces, k=dice.randrange(12)))) for k in range(200)]
    html = F.col("html")
    body = F.regexp_replace(F.regexp_extract("html", r"(?i)<body[^>]*>([\s\S]*?)</body>", 1), r"<!--[\s\S]*?-->", "")
    for tag in ("script", "style"):
        body = F.regexp_replace(body, rf"(?i)<{tag}[\s\S]*?</{tag}>", "")
    part = lambda t: F.concat_ws(":", F.regexp_extract(t, "(?i)<([a-z]+)", 1), F.regexp_extract(t, r"""(?i)class=['"]([^'"]+)['"]""", 1), F.regexp_extract(t, r"""(?i)id=['"]([^'"]+)['"]""", 1))
    tags = F.regexp_extract_all(body, F.lit("(?i)<(?:header|nav|main|section|article|aside|footer|div)[^>]*"), F.lit(0))
    # Without leads each pattern is tried.
    every = matcher.pairs_in(F.lit(" ".join(sorted(hosts.LEADS))), hosts.LEADS)
    df = spark.createDataFrame(pages, "page_id long, html string").select(
        hosts.page_signals(html).alias("got"), hosts.page_signals(html, every).alias("want"), markup.short_hash(F.array_join(F.transform(tags, part), "|")).alias("body"), markup.emails(html).alias("emails"))
    for r in df.collect():
        assert r.got == r.want and {x.key for x in r.got if x.kind == "body"} == {r.body} and [x.key for x in r.got if x.kind == "email"] == r.emails


def test_places_are_those_of_whole_matches(spark):
    one, two = (f"data-website-id='{c * 8}-89ab-cdef-0123-456789abcdef'" for c in "ab")
    # As far from both by the beginnings of matches: the one before is taken; a letter more before makes it the other.
    src, pad = "src='/umami.js'", len(one) - len("src='/umami.js'")
    rows = [(1, f"{one} {src}{' ' * (pad + 1)}{two}"), (2, f"{one}  {src}{' ' * (pad + 1)}{two}"), (3, f"{src} {one} src='/umami2.js'")]
    got = {(r.page_id, r.website_id[0], r.src) for r in identifiers.umami_pairs(spark.createDataFrame(rows, "page_id int, html string")).collect()}
    assert got == {(1, "a", "/umami.js"), (2, "b", "/umami.js"), (3, "a", "/umami.js")}
