from pyspark.sql import functions as F

from tessera.functions import markup
from tessera.operators import correlate, gate, signals
from tessera.plans import fixtures as fx
from tessera.sources import tables


def one(spark, html, column):
    return spark.createDataFrame([(html,)], "html string").select(column(F.col("html")).alias("x")).first()["x"]


def test_entities_decode_one_after_the_other(spark):
    assert one(spark, "a &amp;lt; &#65;&#x42; &quot;&#39;", markup.decode_entities) == "a < AB \"'"


def test_font_families_keep_commas_in_quotes(spark):
    assert one(spark, "<style>a{font-family: 'My, Font', Arial, var(--x, Foo), Inter}</style>", markup.font_families) == ["My, Font", "Inter"]


def test_unclosed_scripts_take_no_quadratic_time(spark):
    assert len(one(spark, "<script>" * 20_000, markup.visible_text)) == 0


def test_no_head_hashes_nothing(spark):
    assert one(spark, "<p>x</p>", markup.head_hash) == "d41d8cd98f00"


def test_fleet_wide_finding_costs_25(spark):
    sites = spark.sql("SELECT * FROM VALUES ('a', 0, 'x'), ('b', 1, 'y') AS t(domain, ord, cluster)")
    found = spark.sql("SELECT 'fleet-wide-tracking-id' AS type, 'critical' AS severity")
    assert correlate.isolation_score(found, sites).first()["score"] == 75


def test_empty_fleet(spark):
    none = spark.sql(fx.SIGNALS).limit(0)
    sites = spark.sql(fx.SITES).limit(0)
    assert correlate.pair_findings(none, sites).isEmpty() and correlate.token_findings(none, sites).isEmpty()


def test_expected_noindex_is_no_failure(spark):
    found = gate.failures(spark.sql(fx.GATES), spark.sql(fx.ROUTES), expect_noindex=True)
    assert found.where("name = 'noindex'").isEmpty()


def test_finding_drift_ignores_the_order_of_sites(spark):
    a = spark.sql("SELECT 't' AS type, array('x', 'y') AS domains, 'd' AS detail")
    b = spark.sql("SELECT 't' AS type, array('y', 'x') AS domains, 'd' AS detail UNION ALL SELECT 'u', array('z'), 'e'")
    assert [tuple(r) for r in gate.finding_drift(a, b).collect()] == [("new", "u", "z", "e")]


def test_fleet_file():
    assert tables.fleet_yaml("name: x # c\ndomains: [a.example, 'b.example']\nexclude:\n  - c.example\n") == {"name": "x", "domains": ["a.example", "b.example"], "exclude": ["c.example"]}


def test_snapshots(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"scans": [{"domain": "a.example", "dns": {"a": ["192.0.2.1"], "txt": ["v=spf1 -all", "k=1"]}}]}')
    (tmp_path / "b.json").write_text('[{"domain": "b.example", "analytics": {"ga4": ["G-1"]}}]')
    found = {tuple(r)[:3] for n in "ab" for r in signals.of_scans(tables.snapshot(spark, str(tmp_path / f"{n}.json"))).collect()}
    assert found == {("a.example", "ip", "192.0.2.1"), ("a.example", "txt", "k=1"), ("b.example", "ga4", "G-1")}
