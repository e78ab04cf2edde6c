"""What a site shares with others, from its scan record: (domain, kind, key) for the pair and token rules.

A record is a row of nested columns as `sources.tables.SNAPSHOT` names them; what a scan left out is null and gives nothing.
All kinds come from one projection and one explode, so records are read once.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import markup, records
from tessera.operators import correlate
from tessera.registry import ACCOUNT_COLLECTORS, CDN_SCRIPTS, COMMODITY_SPF, CRITICAL_ACCOUNTS, IGNORED_ACCOUNTS, PRIVACY

_STRINGS = "array<string>"


def _some(values: Column) -> Column:
    return F.coalesce(values, F.array().cast(_STRINGS))


def under(host: Column, domain: str) -> Column:
    return (F.lower(host) == domain) | F.lower(host).endswith(f".{domain}")


def _any_under(host: Column, domains: tuple[str, ...]) -> Column:
    return reduce(or_, [under(host, d) for d in domains])


def _is_script(x: Column) -> Column:
    return x.rlike(r"\.js(?:\?|$)") | x.contains("/")


def _third_party(url: Column) -> Column:
    return reduce(or_, [url.rlike(f"(?i){p}") for p in CDN_SCRIPTS])


def _addresses(caa: Column, tags: str) -> Column:
    """Mailboxes in CAA records of the given tags."""
    found = F.transform(caa, lambda c: F.regexp_extract(c, rf"(?i)^(?:{tags})\s+(?:mailto:)?(\S+@\S+)$", 1))
    return F.transform(F.filter(found, lambda x: x != ""), F.lower)


def _report_mailboxes() -> Column:
    own = F.transform(F.concat(_some(F.col("dns.dmarc.rua")), _some(F.col("dns.dmarc.ruf"))), F.lower)
    return F.array_distinct(F.concat(own, _addresses(_some(F.col("dns.caa")), "iodef|contactemail")))


def exposed_identifiers(scans: DataFrame) -> DataFrame:
    """Distinct (domain, value, source): e-mail addresses that a scan surfaced."""
    contacts = F.transform(_some(F.col("robots.securityTxtContacts")), lambda x: F.regexp_replace(x, "(?i)^mailto:", ""))
    sources = [
        ("DNS DMARC rua", _some(F.col("dns.dmarc.rua"))), ("DNS DMARC ruf", _some(F.col("dns.dmarc.ruf"))), ("DNS CAA iodef", _addresses(_some(F.col("dns.caa")), "iodef")),
        ("security.txt Contact", F.filter(contacts, lambda x: x.rlike(r"^\S+@\S+$"))), ("HTML mailto", _some(F.col("html.emails"))),
    ]
    each = [markup.tagged(F.transform(v, F.lower), n, name="source") for n, v in sources]
    return scans.select("domain", F.explode(F.concat(*each)).alias("e")).select("domain", "e.value", "e.source").distinct()


def contacts(scans: DataFrame) -> DataFrame:
    """(domain, contact): the mailbox to which a site's reports may go, if its DMARC record names none: the first of security.txt, of
    CAA iodef records, of the page."""
    written = F.transform(_some(F.col("robots.securityTxtContacts")), lambda x: F.regexp_replace(x, "(?i)^mailto:", ""))
    lists = (F.filter(written, lambda x: x.rlike(r"^\S+@\S+$")), _addresses(_some(F.col("dns.caa")), "iodef"), _some(F.col("html.emails")))
    return scans.select("domain", F.lower(F.coalesce(*[F.get(x, F.lit(0)) for x in lists])).alias("contact"))


def of_scans(scans: DataFrame) -> DataFrame:
    """(domain, kind, key, pos) of scan records, by the kinds of the rule tables, a row for each time that a site lists the key, with
    its place in the list; contact e-mails that are report mailboxes of the fleet are left out."""
    c = F.col
    one = lambda x: F.array_compact(F.array(x))
    text = lambda x: F.array_compact(F.array(F.when(x != "", x)))
    keep = lambda values, test: F.filter(_some(values), test)
    other = F.coalesce(c("analytics.other"), F.array().cast("array<struct<name:string,id:string>>"))
    account = lambda critical: F.transform(
        F.filter(other, lambda o: ~o["name"].startswith("DNS:") & ~o["name"].isin(*IGNORED_ACCOUNTS) & (o["name"].isin(*CRITICAL_ACCOUNTS) == F.lit(critical))), lambda o: F.concat_ws("\t", o["name"], o["id"])
    )
    hashes = lambda col, test: F.transform(F.filter(F.coalesce(c(col), F.array().cast("array<struct<url:string,hash:string>>")), lambda h: test(h["url"])), lambda h: h["hash"])
    ends = _some(c("security.reportEndpoints"))
    hosts = F.filter(F.transform(ends, lambda e: F.substring_index(e, "/", 1)), lambda h: _any_under(h, ACCOUNT_COLLECTORS))
    plausible = lambda script: keep(c("analytics.plausible"), lambda x: (_is_script(x) & ~x.contains("plausible.io/")) if script else ~_is_script(x))
    umami = F.coalesce(c("analytics.umami"), F.array().cast("array<struct<websiteId:string,src:string>>"))
    field = lambda a, name: F.filter(F.transform(a, lambda x: x[name]), lambda x: x != "")
    org = c("whois.registrantOrg")
    hidden = reduce(or_, [F.lower(F.trim(org)).contains(p) for p in PRIVACY])
    caa = _some(c("dns.caa"))
    accounts = F.filter(F.transform(caa, lambda x: F.regexp_extract(x, r"(?i)accounturi=([^;\s]+)", 1)), lambda x: x != "")
    kinds = {
        "ip": _some(c("dns.a")), "nameserver": _some(c("dns.ns")), "mx": _some(F.transform("dns.mx", lambda m: F.lower(m["exchange"]))),
        "txt": keep(c("dns.txt"), lambda t: ~t.rlike("(?i)^v=(?:spf|dmarc|dkim|tlsrptv)")), "spf_ip": F.concat(_some(c("dns.spf.ip4")), _some(c("dns.spf.ip6"))),
        "spf_include": keep(c("dns.spf.includes"), lambda x: ~_any_under(x, COMMODITY_SPF)), "report_endpoint": F.concat(ends, hosts),
        "ga4": _some(c("analytics.ga4")), "adsense": _some(c("analytics.adsense")), "gtm": _some(c("analytics.gtm")), "cloudflare": _some(c("analytics.cloudflare")), "facebook": _some(c("analytics.facebook")),
        "clarity": _some(c("analytics.clarity")), "umami_src": field(umami, "src"), "umami_id": field(umami, "websiteId"), "plausible_src": plausible(True), "plausible_domain": plausible(False),
        "account_critical": account(True), "account_high": account(False), "tls_issuer": one(c("tls.issuer")), "tls_san": _some(c("tls.san")), "registrar": text(c("whois.registrar")),
        "registrant": text(F.when(~hidden, org)), "head": one(c("html.headStructureHash")), "body": one(c("html.bodyStructureHash")), "generator": text(c("html.metaGenerator")),
        "inline_script": _some(c("html.inlineScriptHashes")), "sameas": F.flatten(F.transform(F.coalesce(c("html.jsonLd"), F.array().cast("array<struct<sameAs:array<string>>>")), lambda j: _some(j["sameAs"]))),
        "comment": _some(c("html.comments")), "favicon": text(c("assets.faviconHash")), "css": hashes("assets.cssHashes", lambda u: F.lit(True)), "js": hashes("assets.jsHashes", lambda u: ~_third_party(u)),
        "js_cdn": hashes("assets.jsHashes", _third_party), "font": F.transform(_some(c("assets.fontSources")), lambda u: F.substring_index(F.substring_index(u, "/", -1), "?", 1)),
        "form_endpoint": _some(c("html.formEndpoints")), "form_provider": _some(c("security.formProviders")), "twitter_site": text(F.element_at("html.twitterCards", F.lit("twitter:site"))),
        "robots": text(c("robots.robotsTxtHash")), "ads_txt": text(c("robots.adsTxtHash")), "sitemap_path": F.transform(_some(c("robots.sitemapUrls")), records.url_path),
        "sitemap_hash": text(c("robots.sitemapHash")), "ads_pubid": _some(c("robots.adsTxtPubIds")), "redirect_path": _some(c("robots.affiliateRedirectPaths")), "server": text(c("http.serverHeader")),
        "cookie": F.transform(_some(c("http.setCookies")), lambda x: F.substring_index(x, "=", 1)), "report_mailbox": _report_mailboxes(), "caa_account": accounts,
        "google_verification": text(c("dns.googleVerification")), "ms_verification": text(c("dns.microsoftVerification")), "facebook_verification": text(c("dns.facebookVerification")),
    }
    placed = lambda values, kind: F.transform(values, lambda x, i: F.struct(F.lit(kind).alias("kind"), x.alias("key"), i.alias("pos")))
    each = [placed(v, k) for k, v in kinds.items()]
    found = scans.select("domain", F.explode(F.concat(*each)).alias("s")).select("domain", "s.kind", "s.key", "s.pos")
    mails = exposed_identifiers(scans).select("domain", F.lit("email").alias("kind"), F.col("value").alias("key")).distinct().withColumn("pos", F.lit(0))
    taken = found.where("kind = 'report_mailbox'").select("key").distinct()
    return found.unionByName(mails.join(taken, "key", "left_anti").select("domain", "kind", "key", "pos"))


def registrations(scans: DataFrame) -> DataFrame:
    """(domain, created) for registration pairs."""
    return scans.select("domain", F.try_to_timestamp("whois.createdDate").alias("created"))


def mail_links(scans: DataFrame, sites: DataFrame) -> DataFrame:
    """(type, severity, domain, target, key): explicit links by mail records. A mailbox or SPF reference under another site of
    the fleet; of mutual SPF references one a pair stays, that of the site that comes first."""
    boxes = scans.select("domain", F.explode(_report_mailboxes()).alias("key")).withColumn("host", F.lower(F.substring_index("key", "@", -1)))
    refs = F.concat(_some(F.col("dns.spf.includes")), F.array_compact(F.array(F.col("dns.spf.redirect"))))
    spf = scans.select("domain", F.explode(refs).alias("key")).withColumn("host", F.lower("key"))
    named = correlate.suffix_findings(boxes, sites, "report-address-on-fleet-domain", key="key")
    links = correlate.suffix_findings(spf, sites, "spf-references-fleet-domain", key="key").join(sites.select("domain", "ord"), "domain")
    pair = F.array_sort(F.array(F.lower("domain"), F.col("target")))
    first = links.groupBy(pair.alias("pair")).agg(F.min_by(F.struct(*links.drop("ord").columns), F.struct("ord", "key")).alias("f"))
    return named.unionByName(first.select("f.*"))


def mailbox_findings(tokens: DataFrame, links: DataFrame) -> DataFrame:
    """tokens without the shared mailboxes of two sites that an explicit link names already."""
    pair = F.array_join(F.array_sort(F.array(F.lower("domain"), F.col("target"))), ",")
    known = links.where("type = 'report-address-on-fleet-domain'").select(F.lit("shared-report-mailbox").alias("type"), "key", pair.alias("pair")).distinct()
    return tokens.join(known, (tokens["type"] == known["type"]) & (tokens["key"] == known["key"]) & (F.lower(tokens["domains"]) == known["pair"]), "left_anti")
