"""Addresses against Python's own, briefs, reports by shape, stored snapshots."""

import ipaddress
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import addresses, brief, scan, signals
from tessera.sources import snapshots, tables


def own(text):
    try:
        ip = ipaddress.ip_address(text.split("%")[0])
    except ValueError:
        return None
    return ip.ipv4_mapped or ip if ip.version == 6 else ip


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_smallest_range_of_each_address(spark):
    dice = random.Random(4)
    ips = [".".join(str(dice.choice([0, 10, 100, 127, 169, 172, 192, 198, 224, 255, dice.randrange(256)])) for _ in range(4)) for _ in range(300)]
    ips += [str(ipaddress.IPv6Address(dice.getrandbits(128) >> dice.choice([0, 0, 64, 100, 120]))) for _ in range(200)]
    ips += ["::", "::1", "FE80::1", "fe80::1%eth0", "::ffff:10.0.0.1", "::FFFF:a00:1", "1:2:3:4:5:6:1.2.3.4", "1::2::3", "12345::", "1:2:3:4:5:6:7", "256.1.1.1", "1.2.3", "01.2.3.4", "x", "", ":", "1:2:3:4:5:6:7:8:9"]
    nets = [("0.0.0.0/0", "all 4"), ("::/0", "all 6"), ("10.0.0.0/8", "ten"), ("10.0.0.0/31", "two"), ("172.16.0.0/12", "x"), ("192.168.0.0/16", "y"), ("2000::/3", "z"), ("::1/128", "one"), ("fe80::/10", "link"), ("1.2.3.4/40", "none"), ("no", "none"), ("1.2.3.4", "none")]
    known = [(c, n, ipaddress.ip_network(c)) for c, n in nets if n != "none"]
    got = {r.ip: (r.cidr, r["name"]) for r in addresses.classed(spark.createDataFrame([(x,) for x in ips + ips[:5]] + [(None,)], "ip string"), spark.createDataFrame(nets, "cidr string, name string")).collect()}
    want = {}
    for text in set(ips):
        if (ip := own(text)) is not None:
            held = [(net.prefixlen, c, n) for c, n, net in known if net.version == ip.version and ip in net]
            want[text] = max(held)[1:] if held else (None, None)
    assert got == want and len({v for v in want.values()}) > 7


def test_addresses_in_texts(spark):
    text = "At 10.0.0.1, 10.0.0.1. (::1) and 1.2.3.4.5 v1.2.3 12:30 [2001:DB8::5]x x::y 300.1.1.1"
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "10.0.0.1 " * 5000)], "doc_id long, text string")
    got = sorted((r.doc_id, r.ip, r["name"]) for r in addresses.in_texts(rows, addresses.ranges(spark), "doc_id").collect())
    tokens = {t.rstrip(".") for t in re.findall(addresses.TOKEN, text)}
    assert {ip for k, ip, _ in got if k == 1} == {t for t in tokens if own(t) is not None} == {"10.0.0.1", "::1", "2001:DB8::5"}
    assert got == [(1, "10.0.0.1", "private"), (1, "2001:DB8::5", "documentation"), (1, "::1", "loopback"), (4, "10.0.0.1", "private")]


def test_briefs_limit_lines_within_tasks(spark):
    rows = [("a", k, f"line {k}") for k in range(25)] + [("b", k, f"line {k}") for k in (3, 1, 2)] + [("c", k, "same") for k in range(9)]
    out = brief.brief(spark.createDataFrame(rows, "domain string, place int, line string").repartition(4))
    got = {}
    for r in sorted(out.collect(), key=lambda r: r.n):
        got.setdefault(r.domain, []).append(r.line)
    assert got == {"a": [*(f"line {k}" for k in range(8)), "… +17 more"], "b": ["line 1", "line 2", "line 3"], "c": ["same"] * 9}
    assert plan_of(out).count("WindowGroupLimit") >= 2
    assert brief.brief(spark.createDataFrame([], "domain string, place int, line string")).count() == 0


SCAN = {"domain": "a.example", "timestamp": "2024", "dns": {"a": ["192.0.2.1"]}, "analytics": {"ga4": ["G-1"]}}
FINDING = {"type": "shared-ip", "severity": "high", "domains": ["a.example", "b.example"], "detail": "d", "evidence": "e"}


@pytest.mark.parametrize(
    "document, scans, findings",
    [
        ([SCAN, {**SCAN, "domain": "b.example"}], ["a.example", "b.example"], 0), ({"scans": [SCAN], "correlation": {"findings": [FINDING, FINDING], "domains": []}}, ["a.example"], 2), (SCAN, ["a.example"], 0),
        ({"findings": [FINDING], "domains": ["a.example"], "score": 3}, [], 1), ({"domain": "x.example"}, ["x.example"], 0), ([], [], 0), ({"scans": [], "correlation": {"findings": [], "domains": []}}, [], 0),
    ],
)
def test_files_are_read_by_their_shape(spark, tmp_path, document, scans, findings):
    (tmp_path / "f.json").write_text(json.dumps(document, indent=2))
    (tmp_path / "g.json").write_text('{"cut off": [1, ')
    (tmp_path / "h.json").write_text("  ")
    got = snapshots.load(spark, str(tmp_path))
    assert sorted(r.domain for r in got.scans.collect()) == scans
    assert [r.asDict() for r in got.findings.collect()] == [FINDING] * findings
    assert [(r.path.rsplit("/", 1)[1], r.text) for r in got.bad.collect()] == [("g.json", '{"cut off": [1, ')]
    if scans and document != {"domain": "x.example"}:
        assert got.scans.first().dns.a == ["192.0.2.1"]


def test_reports_are_read_back(spark, tmp_path):
    findings = spark.range(1000).select(F.lit("t").alias("type"), F.lit("low").alias("severity"), F.array(F.format_string("s%d", "id"), F.lit('q"\n')).alias("domains"), F.format_string("d%d", "id").alias("detail"), F.lit(None).cast("string").alias("evidence")).repartition(3)
    scans = spark.createDataFrame([(json.dumps(SCAN),)], "t string").select(F.from_json("t", snapshots.tables.SNAPSHOT).alias("r")).select("r.*")
    snapshots.write_report(str(tmp_path / "r"), findings, scans, most=70)
    got = snapshots.load(spark, str(tmp_path / "r"), lines=True)
    assert sorted(map(str, got.findings.collect())) == sorted(map(str, findings.collect()))
    assert got.scans.collect() == scans.collect() and got.bad.count() == 0
    texts = spark.read.text(str(tmp_path / "r")).collect()
    assert len(texts) >= 1000 // 70 and all(set(json.loads(r.value)) == {"scans", "correlation"} for r in texts)


def test_stored_snapshots_are_compared_without_a_shuffle(spark):
    a = [("a.example", "ga4", "G-1"), ("a.example", "ip", "1"), ("a.example", "ip", "1"), ("b.example", "ip", "2"), ("gone.example", "ip", "3"), ("b.example", "ip", None)]
    b = [("a.example", "ip", "1"), ("a.example", "ga4", "G-2"), ("b.example", "ip", "2"), ("new.example", "x", "y")]
    tag = random.randrange(10**9)
    before, after = (snapshots.save(spark.createDataFrame(rows, "domain string, kind string, key string"), f"snap_{tag}_{k}", 4) for k, rows in enumerate((a, b)))
    out = snapshots.drift(before, after)
    assert sorted(map(tuple, out.collect())) == [("a.example", "added", "ga4: G-2"), ("a.example", "removed", "ga4: G-1"), ("gone.example", "removed-domain", ""), ("new.example", "new-domain", "")]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert "Exchange" not in plan_of(snapshots.drift(before, after))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert snapshots.drift(before, before).count() == 0


def test_scanners_are_selected(spark, tmp_path):
    assert scan.expanded(["seo", "html", "dns", "x"]) == ["seo", "html", "robots", "http", "dns", "x"] and scan.unknown(["seo", "x", "dns", "Html"]) == ["x", "Html"]
    html = '<head><meta name="generator" content="G"><script>var a = 1234567;</script></head><body><a href="mailto:A@b.example">m</a><!-- some note --> GTM-ABCD12 hjid: 123456</body>'
    spark.createDataFrame([(1, "https://a.example/", html), (2, "https://b.example/", None)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    pages = tables.pages(spark, str(tmp_path))
    rows = {r.page_id: r for r in scan.scan(pages, ["html", "analytics", "dns"]).collect()}
    assert rows[1].html.metaGenerator == "G" and rows[1].html.emails == ["a@b.example"] and rows[1].analytics.gtm == ["GTM-ABCD12"] and rows[1].analytics.other[0]["name"] == "Hotjar"
    assert rows[1].assets is None and [e.scanner for e in rows[1].errors] == ["dns"] and rows[2].analytics.gtm == []
    with pytest.raises(ValueError, match="unknown scanners: x"):
        scan.scan(pages, ["html", "x"])
    some, none = (plan_of(spark.read.parquet(str(tmp_path / "pages.parquet")).withColumn("host", F.col("url")).transform(scan.scan, only)) for only in (["seo", "analytics"], ["dns"]))
    assert some.count("FileScan") == 1 and "html:string" in some and "html:string" not in none
    assert len(scan.scan(pages).first().errors) == 8 and scan.scan(pages.limit(0)).count() == 0


def test_scan_records_of_pages_meet_the_rules(spark):
    pages = spark.createDataFrame([(1, "a.example", "<!-- shared note -->hjid: 123456"), (2, "b.example", "<!-- shared note -->hjid: 123456")], "page_id long, host string, html string")
    records = scan.scan(pages, ["html", "analytics"]).select(F.to_json(F.struct("domain", "html", "analytics")).alias("j")).select(F.from_json("j", tables.SNAPSHOT).alias("r")).select("r.*")
    found = {(r.kind, r.key) for r in signals.of_scans(records).collect()}
    assert ("comment", "shared note") in found and ("account_critical", "Hotjar\t123456") in found
