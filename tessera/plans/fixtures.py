"""Small inputs for what the driver's tables don't hold, as SQL that Spark and other engines read alike."""

from __future__ import annotations


def _values(columns: str, *rows: tuple) -> str:
    def lit(x) -> str:
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).upper() if isinstance(x, bool) else str(x)

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS t({columns})"


#: Markup added to a page by page_id, so that extractors meet real matches.
EXTRA = (
    '<meta name="generator" content="Astro v4"><meta property="og:title" content="A &amp; B"><meta property="og:type" content="site"><meta property="og:title" content="Later"><link rel="canonical" href="https://a.example/"><script src="/_astro/a.js"></script><script>gtag("config", "G-ABC1234567"); var x = "AW-123456789";</script><img alt="sunset" src="x.png"><img alt="moon" src="y.png">',
    '<meta name="description" content="Plain words &lt;here&gt; &#233;"><meta name="twitter:site" content="@fleet"><script src="https://cdn.example.net/x.js"></script><a href="https://go.nordvpn.net/x">vpn</a><script type="application/ld+json">{"@type":"Org","name":"N","url":"https://n.example","sameAs":["https://s.example/1","https://s.example/2"]}</script>',
    '<form action="https://formspree.io/f/abcd"></form><!-- a real comment --><link rel="alternate" hreflang="de" href="https://a.example/de"><script src="https://a.exosrv.com/ad.js"></script><p>hentai porn xxx, wellness wellness wellness massage</p><a href="https://stripcash.com/x">s</a>',
    '<script src="https://stats.example/umami.js" data-website-id="01234567-89ab-cdef-0123-456789abcdef"></script><a href="mailto:Info@Fleet.example?subject=x">mail</a><style>body{font-family: Inter, "Open, Sans", sans-serif} @font-face{src:url(/f/a.woff2)}</style><link rel="stylesheet" href="/a.css">',
    '<meta property="og:title" content="T"><meta content="D" property="og:description"><meta property="og:image" content="/i.png"><meta property="og:type" content="article"><meta name="rating" content="Mature"><img alt="a bondage set"><p>RTA-5042-1996-1400-1577-RTA</p><script>load("//a.exoclick.com/x"); var mark = 1</script>',
    """<meta name="robots" content="noindex, follow"><script>fbq('init', '123456789012345')</script><svg></svg><div style="background: url(a.png)"></div><script src="https://pagead2.googlesyndication.com/a.js"></script><a href="/go/offer">o</a><script>GTM-ABCD12</script>""",
    '<META CONTENT="NoIndex" NAME="googlebot">',
)
PAGES = "SELECT page_id, url, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, concat(coalesce(html, ''), CASE CAST(page_id % 7 AS INT) " + " ".join(f"WHEN {k} THEN '{x.replace(chr(39), chr(39) * 2)}'" for k, x in enumerate(EXTRA)) + " END) AS html FROM pages"

SITES = _values("domain, ord, cluster", ("alpha.example", 0, "red"), ("beta.example", 1, "red"), ("gamma.example", 2, "blue"), ("delta.example", 3, "blue"), ("eps.example", 4, "Adult one"), ("zeta.example", 5, None))
SIGNALS = _values(
    "domain, kind, key",
    *[(f"{d}.example", "nameserver", "ns1.host.example") for d in ("alpha", "beta", "gamma", "delta")], *[(f"{d}.example", "ga4", "G-AAAAAAA") for d in ("alpha", "beta", "gamma")],
    ("alpha.example", "ip", "192.0.2.1"), ("beta.example", "ip", "192.0.2.1"), ("delta.example", "ip", "192.0.2.1"), ("alpha.example", "gtm", "GTM-X1"), ("delta.example", "gtm", "GTM-X1"),
    ("alpha.example", "form_provider", "tally.so"), ("gamma.example", "form_provider", "tally.so"), ("alpha.example", "form_provider", "cal.com"), ("gamma.example", "form_provider", "cal.com"),
    ("beta.example", "ads_pubid", "pub-1"), ("gamma.example", "ads_pubid", "pub-1"), ("alpha.example", "ads_pubid", "pub-2"), ("beta.example", "ads_pubid", "pub-2"), ("zeta.example", "tls_issuer", ""), ("eps.example", "tls_issuer", ""),
    *[(f"{d}.example", "mx", "mx.mail.example") for d in ("beta", "gamma", "zeta")], ("eps.example", "email", "a@b.example"), ("zeta.example", "email", "a@b.example"), ("alpha.example", "redirect_path", "/go/"), ("delta.example", "redirect_path", "/go/"),
    ("alpha.example", "ip", "192.0.2.1"), ("gamma.example", "cookie", None),
)
REGISTRATIONS = _values("domain, ord, created", ("alpha.example", 0, "2024-01-01 00:00:00"), ("beta.example", 1, "2024-01-05 12:00:00"), ("gamma.example", 2, "2024-01-11 00:00:00"), ("delta.example", 3, "2024-03-01 00:00:00"), ("eps.example", 4, "2024-02-27 06:00:00"), ("zeta.example", 5, None))
MENTIONS = _values("domain, host", ("alpha.example", "mail.beta.example"), ("alpha.example", "other.test"), ("beta.example", "beta.example"), ("sub.alpha.example", "alpha.example"), ("gamma.example", "Delta.Example"), ("zeta.example", None))
FLAGS = _values("domain, signal", ("alpha.example", "adult"), ("eps.example", "adult"), ("zeta.example", "adult-ads"), ("gamma.example", "adult-affiliate"), ("gamma.example", "adult-affiliate"))
HEADERS = _values(
    "domain, name, value",
    ("alpha.example", "Strict-Transport-Security", "max-age=63072000; includeSubDomains"), ("alpha.example", "Content-Security-Policy", "default-src 'self'; script-src 'self' https://x.example; frame-src https://*.calendly.com; form-action https://formspree.io/f/x; report-uri https://R.example/c/?k=1"),
    ("alpha.example", "X-Frame-Options", "DENY"), ("alpha.example", "X-Content-Type-Options", "nosniff"), ("alpha.example", "Referrer-Policy", "no-referrer-when-downgrade"), ("alpha.example", "Server", "cloudflare"), ("alpha.example", "cf-ray", "1"),
    ("beta.example", "Strict-Transport-Security", "max-age=100"), ("beta.example", "Content-Security-Policy", "default-src 'self' 'unsafe-inline'"), ("beta.example", "X-Frame-Options", "ALLOW"), ("beta.example", "Referrer-Policy", "unsafe-url"), ("beta.example", "Server", "nginx/1.18"),
    ("beta.example", "X-Powered-By", "Next.js"), ("beta.example", "NEL", "{}"), ("beta.example", "Reporting-Endpoints", 'main="https://rep.example/x/"'), ("gamma.example", "Via", "1.1 varnish"), ("gamma.example", "Cross-Origin-Opener-Policy", "same-origin"), ("gamma.example", "Report-To", '{"endpoints":[{"url":"https://a.nel.cloudflare.com/r"},{"url":"https://t.report-uri.com/a/b"}]}'),
)
SECURITY_TXT = _values("domain, present", ("alpha.example", True), ("beta.example", False))
MAIL = _values(
    "domain, spf, dmarc, dkim",
    ("alpha.example", "v=spf1 include:_spf.google.com ip4:192.0.2.0/24 -all", "v=DMARC1; p=reject; rua=mailto:D@alpha.example!10m,mailto:x@y.example", 1), ("beta.example", "v=spf1 +all", "v=DMARC1; p=none", 0),
    ("gamma.example", "v=spf1 a redirect=_s.gamma.example", "v=DMARC1; p=quarantine; pct=50; sp=reject", 0), ("delta.example", None, None, 0), ("eps.example", "v=spf1 mx ?all", "v=DMARC1; rua=mailto:q@eps.example", 2),
)
TXT = _values("domain, value", ("alpha.example", "google-site-verification=abc_1"), ("alpha.example", "stripe-verification=9f"), ("beta.example", "amazonses: Qq+/="), ("beta.example", "x amazonses: no"), ("gamma.example", "Yandex-Verification: 0aF"), ("gamma.example", "v=spf1 -all"))
ROBOTS = _values(
    "domain, body",
    ("alpha.example", "User-agent: GPTBot\nUser-agent: CCBot # two\nDisallow: /\n\nUser-agent: *\nDisallow: /admin\nAllow: /\nDisallow: /go/"), ("beta.example", "User-agent: *\nDisallow: /\nSitemap: https://beta.example/s.xml"), ("gamma.example", ""), ("delta.example", "nothing here\nUser-agent: a\nDisallow:\nUser-agent: b\nDisallow: /b"),
)
WHOIS = _values("domain, body", ("alpha.example", "Registrar: Names Ltd\nCreation Date: 2020-01-02T00:00:00Z\nRegistry Expiry Date: 2031-05-06T00:00:00Z\nName Server: NS1.X.EXAMPLE\nName Server: ns1.x.example\nRegistrant Organization: Acme"), ("beta.example", "created: 2019-03-04\nexpires: soon\nnserver: a.b.example\ncountry: DE\nUpdated Date: 2024-02-03\nDNSSEC: unsigned\nExpiration Date: 2026-01-31"))
ADDRESSES = _values("ip", *[(x,) for x in ("10.1.2.3", "8.8.8.8", "172.31.0.1", "172.32.0.1", "100.64.0.1", "192.0.2.7", "300.1.1.1", "x", "169.254.169.254", "198.18.0.1", "224.0.0.1")])
GATES = _values(
    "domain, cluster, status, is_adult, noindex, security, security_txt, spf_rating, dmarc_rating, errors",
    ("alpha.example", "red", 200, True, False, 80, True, "good", "warning", 0), ("beta.example", "red", 503, False, True, 20, False, "missing", "missing", 1), ("eps.example", "Adult one", 200, True, False, None, True, None, None, 0), ("gamma.example", None, 200, True, False, 90, True, "good", "good", 0),
)
ROUTES = _values("domain, route, status, noindex, seo", ("alpha.example", "/about", 404, False, None), ("alpha.example", "/x", 200, True, 70), ("gamma.example", "/about", 200, False, 30), ("beta.example", "/about", None, False, None))
BEFORE = _values("domain, noindex, adult, security, seo, spf, dmarc", ("alpha.example", False, 0, 80, 70, "good", "good"), ("beta.example", False, 20, 60, None, "missing", "good"), ("gamma.example", True, 5, 50, 50, "good", None))
AFTER = _values("domain, noindex, adult, security, seo, spf, dmarc", ("alpha.example", True, 10, 80, 75, "good", "good"), ("beta.example", False, 25, 61, 40, "good", None), ("delta.example", False, 0, 10, 10, "good", "good"))
IDS_BEFORE = _values("domain, kind, id", ("alpha.example", "ga4", "G-1"), ("beta.example", "gtm", "GTM-1"), ("gamma.example", "ga4", "G-9"))
IDS_AFTER = _values("domain, kind, id", ("alpha.example", "ga4", "G-2"), ("beta.example", "gtm", "GTM-1"), ("beta.example", "ga4", "G-3"))

ADDRESSES_6 = _values("ip", *[(x,) for x in ("::1", "::", "fc00::1", "fd12:3456::1", "fe80::1%eth0", "ff02::1", "2606:4700::1111", "2001:4860:4860::8888", "::ffff:127.0.0.1", "::ffff:7f00:1", "0:0:0:0:0:ffff:7f00:1", "::ffff:8.8.8.8", "::ffff:808:808", "::ffff:10.0.0.1", "1::2::3", "12345::1", "::ffff:300.1.1.1", "")])

_ALPHA = """{"domain":"alpha.example","http":{"statusCode":200,"serverHeader":"cloudflare","setCookies":["sid=1; Path=/","=x"]},
"dns":{"a":["192.0.2.1"],"ns":["ns1.host.example"],"txt":["v=spf1 -all","k=1"],"mx":[{"exchange":"MX.Mail.example","priority":1}],"spf":{"includes":["_spf.google.com","relay.beta.example"],"ip4":["192.0.2.9"],"ip6":[]},
"dmarc":{"rua":["D@beta.example"],"ruf":[]},"caa":["issue ca.example; accounturi=https://acme.example/1","iodef mailto:Sec@alpha.example"],"googleVerification":"g1","microsoftVerification":""},
"analytics":{"ga4":["G-1","G-2"],"plausible":["https://plausible.io/js/p.js","https://p.alpha.example/js/x.js","alpha.example"],"umami":[{"websiteId":"w1","src":"/u.js"},{"websiteId":"","src":""}],
"other":[{"name":"Hotjar","id":"1"},{"name":"Crisp Website","id":"c"},{"name":"DNS:Stripe","id":"s"},{"name":"Matomo Site ID","id":"1"}]},
"whois":{"registrar":"Names","registrantOrg":"REDACTED FOR PRIVACY (x)","createdDate":"2024-01-01T00:00:00Z"},"tls":{"issuer":"R3","san":["alpha.example"]},
"html":{"headStructureHash":"h","bodyStructureHash":"b","metaGenerator":"","inlineScriptHashes":["i"],"comments":["c"],"emails":["Info@fleet.example","d@beta.example"],"formEndpoints":["f"],"twitterCards":{"twitter:site":"@f"},"jsonLd":[{"sameAs":["s"]}]},
"assets":{"faviconHash":"v","cssHashes":[{"url":"/a.css","hash":"c1"}],"jsHashes":[{"url":"/a.js","hash":"j1"},{"url":"https://unpkg.com/x.js","hash":"j2"}],"fontSources":["https://x.example/f/inter.woff2?v=1"]},
"security":{"reportEndpoints":["acme.report-uri.com/r","c.example/x"],"formProviders":["tally.so"]},
"robots":{"robotsTxtHash":"r","adsTxtHash":"a","adsTxtPubIds":["pub-1"],"sitemapUrls":["https://alpha.example/sitemap.xml","https://alpha.example/map/x.xml"],"sitemapHash":"m","affiliateRedirectPaths":["/go/"],"securityTxtContacts":["mailto:sec2@alpha.example","https://x"]}}"""
_BETA = """{"domain":"beta.example","http":{"statusCode":503},"dns":{"spf":{"includes":["_spf.alpha.example"],"ip4":[],"ip6":[]},"dmarc":{"rua":["d@beta.example"]}},"whois":{"registrantOrg":"Acme","createdDate":"2024-01-05T00:00:00Z"},"analytics":{"ga4":["G-1","G-2"]}}"""
_GAMMA = """{"domain":"gamma.example","errors":[{"scanner":"dns","error":"no answer"},{"scanner":"http","error":"timeout"}]}"""
_DELTA = """{"domain":"delta.example","http":{"statusCode":200},"dns":{"googleVerification":"g1","caa":["issue x; accounturi=https://acme.example/1"]}}"""
SCANS = _values("record", *[(x.replace("\n", ""),) for x in (_ALPHA, _BETA, _GAMMA, _DELTA)])
SCAN_SITES = _values("domain, ord, cluster", ("alpha.example", 0, "red"), ("beta.example", 1, "red"), ("gamma.example", 2, "blue"), ("delta.example", 3, None))
#: What alpha and the others share, (kind, keys), worked out by hand.
SCAN_SIGNALS = {
    "alpha.example": (
        ("server", "cloudflare"), ("cookie", "sid"), ("cookie", ""), ("ip", "192.0.2.1"), ("nameserver", "ns1.host.example"), ("mx", "mx.mail.example"), ("txt", "k=1"), ("spf_ip", "192.0.2.9"), ("spf_include", "relay.beta.example"),
        ("report_endpoint", "acme.report-uri.com/r"), ("report_endpoint", "acme.report-uri.com"), ("report_endpoint", "c.example/x"), ("ga4", "G-1"), ("ga4", "G-2"), ("plausible_src", "https://p.alpha.example/js/x.js"),
        ("plausible_domain", "alpha.example"), ("umami_src", "/u.js"), ("umami_id", "w1"), ("account_critical", "Hotjar\t1"), ("account_high", "Crisp Website\tc"), ("registrar", "Names"), ("tls_issuer", "R3"), ("tls_san", "alpha.example"),
        ("head", "h"), ("body", "b"), ("inline_script", "i"), ("comment", "c"), ("form_endpoint", "f"), ("twitter_site", "@f"), ("sameas", "s"), ("favicon", "v"), ("css", "c1"), ("js", "j1"), ("js_cdn", "j2"), ("font", "inter.woff2"),
        ("form_provider", "tally.so"), ("report_mailbox", "d@beta.example"), ("report_mailbox", "sec@alpha.example"), ("caa_account", "https://acme.example/1"), ("google_verification", "g1"), ("email", "info@fleet.example"),
        ("email", "sec2@alpha.example"), ("robots", "r"), ("ads_txt", "a"), ("ads_pubid", "pub-1"), ("sitemap_path", "/sitemap.xml"), ("sitemap_path", "/map/x.xml"), ("sitemap_hash", "m"), ("redirect_path", "/go/"),
    ),
    "beta.example": (("spf_include", "_spf.alpha.example"), ("report_mailbox", "d@beta.example"), ("registrant", "Acme"), ("ga4", "G-1"), ("ga4", "G-2")),
    "delta.example": (("google_verification", "g1"), ("caa_account", "https://acme.example/1")),
}
FILES = _values(
    "domain, robots, ads, security, humans, sitemap",
    ("alpha.example", "User-agent: *\nDisallow: /go/x\nDisallow: /out\nDisallow: /private\nSitemap: https://alpha.example/s.xml\n", "# ads\ngoogle.com, pub-1, DIRECT\ngoogle.com, pub-1, DIRECT\nx.example,pub-2 , RESELLER\nnothing", "# c\nContact: mailto:a@alpha.example\nContact: https://alpha.example/c\nExpires: 2026-03-02T00:00:00Z\nPolicy: https://alpha.example/p\n-----BEGIN PGP SIGNED MESSAGE-----", "Team: Ann\n\nContact: ann@alpha.example\nSite: x", "<url><loc>https://alpha.example/1</loc><lastmod>2026-01-01</lastmod></url>"),
    ("beta.example", "  <!doctype html><p>no such page</p>", None, "Expires: soon", "", "<url> <loc>https://beta.example/9</loc>\n<lastmod>2020-01-01</lastmod></url>"),
)
TXT_SETS = _values("domain, txt", ("alpha.example", "v=spf1 -all"), ("alpha.example", "google-site-verification=abc"), ("alpha.example", "MS=ms123"), ("alpha.example", "facebook-domain-verification=f9"), ("alpha.example", " V=DMARC1; p=none"), ("beta.example", "v=spf10 -all"), ("beta.example", "x google-site-verification=no"), ("beta.example", "v=DKIM1; k=rsa; p=MIG"), ("beta.example", "v=DKIM1; p="))
RDAP = _values(
    "domain, body",
    ("alpha.example", '{"entities":[{"roles":["registrar"],"handle":"9","vcardArray":["vcard",[["version",{},"text","4.0"],["fn",{},"text","Names Ltd"]]]},{"roles":["registrant"],"vcardArray":["vcard",[["org",{},"text","Acme"],["adr",{},"text",["","","S","C","R","1","DE"]]]]}],"events":[{"eventAction":"registration","eventDate":"2020-01-02"},{"eventAction":"expiration","eventDate":"2030-01-02"}],"nameservers":[{"ldhName":"NS1.X.EXAMPLE"},{"ldhName":"ns1.x.example"}],"secureDNS":{"delegationSigned":true}}'),
    ("beta.example", '{"entities":[{"roles":["registrar"],"handle":"42"}],"events":[{"eventAction":"last changed","eventDate":"2021-05-06"}]}'), ("gamma.example", "no json"),
)
REFERENCES = _values("base, ref", *[("https://a.example/x/y.html?q#f", r) for r in ("https://b.example/z", "//c.example/z", "/root", "rel.css", "./rel.css", "../up.css", "?p=1", "mailto:a@b.example", "#top")], ("https://a.example", "z"))
FETCHES = _values("url, target, answer", ("https://alpha.example/x", "alpha.example", None), ("http://10.0.0.1/", "alpha.example", None), ("http://8.8.8.8/", "alpha.example", None), ("http://[::1]/", "alpha.example", None), ("file:///etc/passwd", "alpha.example", None), ("https://b.example/", "alpha.example", "93.184.216.34"), ("https://c.example/", "alpha.example", "127.0.0.1"), ("https://d.example/", "alpha.example", None))
SITE_SEO = _values("domain, robots_scanned, robots, sitemaps, status, scheme", ("alpha.example", True, "User-agent: *", 2, 200, "https"), ("beta.example", True, None, 0, 200, "http"), ("gamma.example", False, None, None, 503, None), ("delta.example", True, "", 1, None, None))
SCORES = _values("domain, score, is_adult", ("alpha.example", 40, True), ("beta.example", 10, False), ("eps.example", 90, True))
ERRORS = _values("domain, error", ("gamma.example", "HTTP 503"))
NOTES_HEADERS = _values("domain, name, value", ("alpha.example", "Access-Control-Allow-Origin", "*"), ("alpha.example", "Content-Security-Policy", "script-src 'self' https://cdn.example *.good.example; img-src *"), ("beta.example", "Access-Control-Allow-Origin", "*"), ("gamma.example", "Content-Security-Policy", "default-src *"), ("delta.example", "Access-Control-Allow-Origin", "https://x.example"))
COLLAPSIBLE = _values(
    "type, severity, a, b, detail",
    ("shared-fonts", "low", "a.example", "b.example", "inter.woff2"), ("shared-fonts", "medium", "a.example", "c.example", "inter.woff2"), ("shared-fonts", "low", "b.example", "c.example", "inter.woff2"), ("shared-mx", "low", "a.example", "b.example", "mx"), ("shared-mx", "low", "a.example", "c.example", "mx"),
    ("shared-form-provider", "medium", "a.example", "b.example", "calendly.com"), ("shared-form-provider", "medium", "a.example", "c.example", "calendly.com"), ("shared-form-provider", "medium", "b.example", "c.example", "calendly.com"), ("shared-ga4", "critical", "a.example", "b.example", "G-1"),
)
BODIES = _values("url, body", ("https://a.example/favicon.ico", "icon"), ("https://a.example/a.css", "p{}"), ("https://a.example/a.js", "x()"), ("https://cdn.example/b.js", "y()"))
ROUTE_SCORES = _values("domain, route, score", ("alpha.example", "/", 40), ("alpha.example", "/ok", 90), ("beta.example", "/de/x", 45), ("gamma.example", "/", None))
ROUTE_CHECKS = _values("domain, route, check_, rating", ("alpha.example", "/", "Title", "missing"), ("alpha.example", "/", "Hreflang", "warning"), ("alpha.example", "/", "Language", "good"), ("beta.example", "/de/x", "Hreflang", "warning"), ("beta.example", "/de/x", "Title", "warning"), ("beta.example", "/", "Sitemap", "missing"))
CHECKS_BEFORE = _values("domain, route, check_, rating", ("alpha.example", "/", "Title", "good"), ("alpha.example", "/", "Hreflang", "warning"), ("alpha.example", "/gone", "Title", "missing"), ("beta.example", "/", "Title", "missing"))
CHECKS_AFTER = _values("domain, route, check_, rating", ("alpha.example", "/", "Title", "missing"), ("alpha.example", "/", "Hreflang", "good"), ("beta.example", "/", "Title", "missing"), ("beta.example", "/new", "Title", "missing"))
AUDITS_BEFORE = _values("domain, route, ok, noindex, canonical, seo", ("alpha.example", "/a", True, False, "x", 50), ("alpha.example", "/b", True, False, None, 50), ("alpha.example", "/c", True, False, None, 70), ("alpha.example", "/gone", True, False, None, 1))
AUDITS_AFTER = _values("domain, route, ok, noindex, canonical, seo", ("alpha.example", "/a", False, True, None, None), ("alpha.example", "/b", True, True, "https://a.example/b", 60), ("alpha.example", "/c", True, False, None, 70), ("alpha.example", "/new", True, False, None, 1))
MAIL_BEFORE = _values("domain, check_, rating, value", ("alpha.example", "SPF", "good", "-all"), ("alpha.example", "DMARC", "missing", None), ("beta.example", "DMARC", "good", "reject"), ("beta.example", "SPF", "good", "-all"), ("gamma.example", "SPF", "good", "-all"))
MAIL_AFTER = _values("domain, check_, rating, value", ("alpha.example", "SPF", "missing", None), ("alpha.example", "DMARC", "good", "reject"), ("beta.example", "DMARC", "warning", "none"), ("beta.example", "SPF", "good", "~all"), ("gamma.example", "SPF", "good", "-all"))
SITEMAPS = _values(
    "domain, sitemap, xml",
    ("alpha.example", "https://alpha.example/i.xml", "<sitemapindex><sitemap><loc> https://alpha.example/s1.xml </loc></sitemap><sitemap><loc>https://alpha.example/s2.xml</loc></sitemap></sitemapindex>"),
    ("alpha.example", "https://alpha.example/s1.xml", "<urlset><url><loc>https://alpha.example/</loc></url><url><loc>https://alpha.example/a</loc></url><url><loc>https://alpha.example/f.PDF</loc></url></urlset>"),
    ("alpha.example", "https://alpha.example/s3.xml", "<urlset><url><loc>https://alpha.example/never</loc></url></urlset>"), ("beta.example", "https://beta.example/s.xml", "<URLSET><LOC>https://beta.example/b</LOC><loc>https://beta.example</loc><loc>https://beta.example/x.xml.gz</loc></URLSET>"),
)
ROOTS = _values("domain, sitemap", ("alpha.example", "https://alpha.example/i.xml"), ("beta.example", "https://beta.example/s.xml"))
FRONT_IDS = _values("domain, name, id", ("alpha.example", "GTM Container", "GTM-1"), ("alpha.example", "DNS:Stripe", "s"))
SUBPAGE_IDS = _values("domain, name, id", ("alpha.example", "GTM Container", "GTM-1"), ("alpha.example", "Hotjar", "1"), ("alpha.example", "DNS:Linear", "l"), ("beta.example", "Hotjar", "2"))
AUDITED = _values(
    "page_id, domain, route, url, html, status",
    (1, "alpha.example", "/a", "https://alpha.example/a", '<html lang="en"><head><title>Thirty letters of a title, or more</title><meta name="viewport" content="x"><link rel="canonical" href="https://alpha.example/a"></head></html>', 200),
    (2, "alpha.example", "/b", "https://alpha.example/b", '<meta name="robots" content="noindex">', 204), (3, "alpha.example", "/c", "https://alpha.example/c", "gone", 404), (4, "beta.example", "/d", "https://beta.example/d", None, None),
)
