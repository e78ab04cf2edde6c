"""Rules on pairs of scan records, gates and fixes, where repeats, order and fall-backs decide."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import markup
from tessera.operators import correlate, gate, scoring, signals
from tessera.plans import queries as plans
from tessera.sources import tables


@pytest.fixture(scope="module")
def scans(spark):
    def read(*records):
        rows = spark.createDataFrame([(json.dumps(r),) for r in records], "record string")
        scans = rows.select(F.from_json("record", tables.SNAPSHOT).alias("r")).select("r.*")
        order = {r["domain"]: k for k, r in enumerate(records)}
        sites = spark.createDataFrame([(d, k, None) for d, k in order.items()], "domain string, ord int, cluster string")
        return scans, sites

    return read


def pairs(scans, sites):
    return {(r.type, r.a, r.b): (r.n, r.detail) for r in correlate.pair_findings(signals.of_scans(scans), sites).collect()}


def test_repeats_at_the_first_site_count(scans):
    page = lambda d, scripts, comments: {"domain": d, "html": {"inlineScriptHashes": scripts, "comments": comments}}
    found = pairs(*scans(page("a.example", ["x", "x", "y", "z"], ["c"]), page("b.example", ["x", "y", "y"], ["c", "c"])))
    assert found == {("shared-inline-scripts", "a.example", "b.example"): (3, "x, y"), ("shared-comments", "a.example", "b.example"): (1, "c")}
    found = pairs(*scans(page("b.example", ["x", "y", "y"], ["c", "c"]), page("a.example", ["x", "x", "y", "z"], ["c"])))
    assert found == {("shared-inline-scripts", "b.example", "a.example"): (3, "x, y"), ("shared-comments", "b.example", "a.example"): (2, "c")}


def test_the_first_shared_sitemap_decides(scans):
    maps = lambda d, *paths: {"domain": d, "robots": {"sitemapUrls": [f"https://{d}{p}" for p in paths]}}
    usual_first = scans(maps("a.example", "/only-a.xml", "/sitemap.xml", "/m.xml"), maps("b.example", "/m.xml", "/sitemap.xml"))
    assert pairs(*usual_first) == {} and correlate.similarity(signals.of_scans(usual_first[0]), usual_first[1]).count() == 0
    other_first = scans(maps("b.example", "/m.xml", "/sitemap.xml"), maps("a.example", "/only-a.xml", "/sitemap.xml", "/m.xml"))
    assert pairs(*other_first) == {("shared-sitemap-structure", "b.example", "a.example"): (2, "/m.xml, /sitemap.xml")}


def test_the_first_shared_cookie_decides(scans):
    http = lambda d, *names: {"domain": d, "http": {"statusCode": 200, "setCookies": [f"{n}=1; Path=/" for n in names]}}
    assert pairs(*scans(http("a.example", "", "sid"), http("b.example", "sid", ""))) == {}
    assert pairs(*scans(http("b.example", "sid", ""), http("a.example", "", "sid"))) == {("shared-cookies", "b.example", "a.example"): (2, ", sid")}


def test_ids_are_fleet_wide_by_occurrences(scans):
    """An id that two sites list three times in all, under whatever collector, gives no pair finding; one listed twice does."""
    a = {"domain": "a.example", "analytics": {"clarity": ["same"], "cloudflare": ["same"], "ga4": ["G-1"]}}
    b = {"domain": "b.example", "analytics": {"clarity": ["same"], "ga4": ["G-1"]}}
    assert pairs(*scans(a, b)) == {("shared-ga4", "a.example", "b.example"): (1, "G-1")}


def test_each_pair_of_installs_is_a_finding(scans):
    install = lambda *srcs: [{"websiteId": f"w{k}", "src": s} for k, s in enumerate(srcs)]
    records, sites = scans({"domain": "a.example", "analytics": {"umami": install("/u.js", "/u.js", "/v.js")}}, {"domain": "b.example", "analytics": {"umami": install("/u.js", "/u.js")}})
    found = correlate.pair_findings(signals.of_scans(records), sites).where("type = 'shared-umami-src'").collect()
    assert len(found) == 4 and {r.n for r in found} == {1}
    assert correlate.similarity(signals.of_scans(records).where("kind = 'umami_src'"), sites).first().similarity == 100


@pytest.mark.parametrize(
    "html, found",
    [
        ('<meta name="robots" content="noindex">', True), ('<meta name="googlebot" content="NOINDEX,nofollow">', True), ("<META CONTENT='noindex' NAME='googlebot'>", True),
        ('<meta name="robots" content="all"><meta name="googlebot" content="noindex">', False), ('<meta name="googlebot" content="all"><meta name="robots" content="none, noindex">', True), ("<p>noindex</p>", False),
    ],
)
def test_noindex_falls_back_to_googlebot(spark, html, found):
    assert spark.createDataFrame([(html,)], "html string").select(markup.noindex(F.col("html"))).first()[0] is found


def test_dmarc_reports_go_to_a_known_mailbox(scans):
    full = {"domain": "a.example", "dns": {"caa": ["iodef mailto:Caa@a.example"]}, "robots": {"securityTxtContacts": ["https://a.example/c", "mailto:Sec@a.example"]}, "html": {"emails": ["html@a.example"]}}
    rest = [{"domain": "b.example", "dns": {"caa": ["issue x", "iodef mailto:Caa@b.example"]}, "html": {"emails": ["html@b.example"]}}, {"domain": "c.example", "html": {"emails": ["Html@c.example"]}}, {"domain": "d.example"}]
    records, _ = scans(full, *rest)
    known = signals.contacts(records)
    fixes = lambda dmarc: {r.domain: r.fix for r in scoring.dmarc_fix(known.withColumn("dmarc", F.lit(dmarc))).collect()}
    who = {"a.example": "sec@a.example", "b.example": "caa@b.example", "c.example": "html@c.example", "d.example": "postmaster@d.example"}
    assert fixes(None) == {d: f"v=DMARC1; p=quarantine; rua=mailto:{m}" for d, m in who.items()}
    assert fixes("v=DMARC1; p=none; rua=mailto:Old@x.example") == {d: "v=DMARC1; p=quarantine; rua=mailto:old@x.example" for d in who}
    assert fixes("v=DMARC1; p=reject; pct=20") == {d: f"v=DMARC1; p=reject; pct=100; rua=mailto:{m}" for d, m in who.items()}
    assert fixes("v=DMARC1; p=reject") == {}


def test_low_seo_scores_fail_on_demand_only(spark):
    sites = spark.createDataFrame([("a.example", None, 200, False, False, 90, True, "good", "good", 0)], "domain string, cluster string, status int, is_adult boolean, noindex boolean, security int, security_txt boolean, spf_rating string, dmarc_rating string, errors int")
    routes = spark.createDataFrame([("a.example", "/low", 200, False, 5)], "domain string, route string, status int, noindex boolean, seo int")
    assert gate.failures(sites, routes).count() == 0
    scores, checks = spark.createDataFrame([("a.example", "/low", 5)], "domain string, route string, score int"), spark.createDataFrame([], "domain string, route string, check string, rating string")
    assert gate.seo_failures(scores, checks).count() == 0 and gate.seo_failures(scores, checks, min_seo=50).count() == 1


def test_low_seo_scores_of_routes_fail_when_asked_for(spark):
    sites = spark.createDataFrame([("a.example", None, 200, False, False, 90, True, "good", "good", 0)], "domain string, cluster string, status int, is_adult boolean, noindex boolean, security int, security_txt boolean, spf_rating string, dmarc_rating string, errors int")
    routes = spark.createDataFrame([("a.example", "/low", 200, False, 5), ("a.example", "/high", 200, False, 50), ("a.example", "/gone", 404, False, 5), ("a.example", "/none", 200, False, None)], "domain string, route string, status int, noindex boolean, seo int")
    failed = gate.failures(sites, routes, min_seo=50)
    assert sorted(map(tuple, failed.collect())) == [("a.example", "/gone", "route", "404"), ("a.example", "/low", "seo", "5")]
    assert {(r.route, r.name): (r.k, r.n) for r in gate.rollup(failed, sites).collect()} == {("/gone", "route"): (1, 1), ("/low", "seo"): (1, 1)}


def test_the_gate_queries_hold_the_seo_gate(spark):
    assert [r.route for r in plans.gate_failures(spark, "").where("name = 'seo'").collect()] == ["/about"]
    assert plans.gate_rollup(spark, "").where("name = 'seo'").count() == 1
    assert {r.domain: r.code for r in plans.gate_exit_codes(spark, "").collect()}["gamma.example"] == 1


def test_hreflang_with_spaces(spark):
    pages = spark.createDataFrame([(1, "https://a.example/", '<link rel="alternate" hreflang = "de" href="/de">'), (2, "https://a.example/", '<link rel="alternate" href="/hreflang">')], "page_id long, url string, html string")
    assert {r.page_id: r.rating for r in scoring.seo_checks(pages).where("check = 'Hreflang'").collect()} == {1: "good", 2: "warning"}
