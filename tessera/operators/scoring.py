"""Scores as long tables of checks: security headers, search appearance, content class, e-mail authentication, technology."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import markup, matcher, records
from tessera.registry import AD_NETWORKS, ADULT_RATING, AFFILIATES, COMMODITY_COLLECTORS, FORM_PROVIDERS, KEYWORDS, LEGAL_SEGMENT, PROVIDER_DIRECTIVES, REDIRECT, RTA_LABEL, TECHNOLOGIES, WEIGHT, java


def directive(csp: Column, name: str) -> Column:
    """Sources of the first directive of that name, lower-cased; null without it."""
    found = F.regexp_extract(F.lower(csp), rf"(?:^|;)\s*{name}(?:\s+([^;]*))?(?:;|$)", 1)
    has = F.lower(csp).rlike(rf"(?:^|;)\s*{name}(?:\s|;|$)")
    return F.when(has, F.trim(found))


def _rated(v: Column) -> list[tuple[str, int, Column]]:
    """(header, weight, rating) with v(header) the value or null."""
    age = F.regexp_extract(v("strict-transport-security"), r"max-age=(\d+)", 1).try_cast("long")
    hsts = (F.coalesce(age, F.lit(0)) >= 31536000) & F.lower(v("strict-transport-security")).contains("includesubdomains")
    script = F.coalesce(directive(v("content-security-policy"), "script-src"), directive(v("content-security-policy"), "default-src"), F.lit(""))
    ref = F.lower(v("referrer-policy"))
    strict = ref.contains("no-referrer") | ref.contains("strict-origin") | ref.contains("same-origin")
    have = lambda name, good, other="warning": F.when(v(name).isNull(), "missing").when(good, "good").otherwise(other)
    low = lambda name: F.lower(v(name))
    return [
        ("strict-transport-security", 15, have("strict-transport-security", hsts)),
        ("content-security-policy", 15, have("content-security-policy", ~script.contains("'unsafe-inline'") & ~script.contains("'unsafe-eval'"))),
        ("x-frame-options", 15, have("x-frame-options", F.upper(v("x-frame-options")).isin("DENY", "SAMEORIGIN"))),
        ("x-content-type-options", 15, have("x-content-type-options", low("x-content-type-options").contains("nosniff"))),
        ("referrer-policy", 15, F.when(v("referrer-policy").isNull(), "missing").when(strict, "good").when(ref.contains("unsafe-url"), "bad").otherwise("warning")),
        ("permissions-policy", 15, have("permissions-policy", F.lit(True))),
        ("cross-origin-opener-policy", 15, have("cross-origin-opener-policy", low("cross-origin-opener-policy").contains("same-origin"))),
        ("cross-origin-embedder-policy", 15, have("cross-origin-embedder-policy", low("cross-origin-embedder-policy").rlike("require-corp|credentialless"))),
        ("cross-origin-resource-policy", 15, have("cross-origin-resource-policy", low("cross-origin-resource-policy").rlike("same-origin|same-site|cross-origin"))),
        ("server", 5, F.when(F.coalesce(v("server").rlike(r"\d+\.\d+"), F.lit(False)), "warning").otherwise("good")),
        ("x-powered-by", 5, F.when(v("x-powered-by").isNull(), "good").otherwise("warning")),
    ]


def _wide(headers: DataFrame) -> DataFrame:
    """(domain, h map) from (domain, name, value); of a repeated name the largest value counts, as rows have no order."""
    one = headers.groupBy("domain", F.lower("name").alias("name")).agg(F.max("value").alias("value"))
    return one.groupBy("domain").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("h"))


def security_checks(headers: DataFrame) -> DataFrame:
    """(domain, check, weight, rating, points) of eleven checks on response headers (domain, name, value)."""
    rated = _rated(lambda name: F.element_at("h", F.lit(name)))
    checks = F.array(*[F.struct(F.lit(n).alias("check"), F.lit(w).alias("weight"), r.alias("rating")) for n, w, r in rated])
    out = _wide(headers).select("domain", F.explode(checks).alias("c")).select("domain", "c.*")
    points = F.when(F.col("rating") == "good", F.col("weight")).when(F.col("rating") == "warning", F.floor(F.col("weight") / 2)).otherwise(0)
    return out.withColumn("points", points.cast("int"))


def percent(points: Column, most: Column) -> Column:
    """Rounded half up; null if there was nothing to score."""
    return F.when(most > 0, F.floor(100.0 * points / most + 0.5).cast("int"))


def security_score(headers: DataFrame, security_txt: DataFrame) -> DataFrame:
    """(domain, score); security_txt (domain, present) adds an optional five points where it was looked for."""
    sums = security_checks(headers).groupBy("domain").agg(F.sum("points").alias("p"), F.sum("weight").alias("m"))
    both = sums.join(security_txt, "domain", "left")
    more = lambda yes: F.when(F.col("present").isNull(), 0).when(yes, 5).otherwise(0)
    return both.select("domain", percent(F.col("p") + more(F.col("present")), F.col("m") + more(F.lit(True))).alias("score"))


def form_providers(headers: DataFrame) -> DataFrame:
    """(domain, provider): form and booking services that a content security policy allows."""
    csp = headers.where(F.lower("name") == "content-security-policy").select("domain", F.col("value").alias("csp"))
    tokens = F.flatten(F.array(*[F.split(F.coalesce(directive(F.col("csp"), d), F.lit("")), r"\s+") for d in PROVIDER_DIRECTIVES]))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("t"), "^[a-z][a-z0-9+.-]*://", ""), r"^\*\.", ""), "[:/].*$", "")
    hosts = csp.select("domain", F.explode(tokens).alias("t")).select("domain", host.alias("host"))
    hits = F.filter(F.array(*[F.lit(p) for p in FORM_PROVIDERS]), lambda p: (F.col("host") == p) | F.col("host").endswith(F.concat(F.lit("."), p)))
    return hosts.select("domain", F.explode(hits).alias("provider")).distinct()


def report_endpoints(headers: DataFrame) -> DataFrame:
    """(domain, endpoint): host, without its port, and path that violation reports go to."""
    name, value = F.lower("name"), F.col("value")
    policy = name.isin("content-security-policy", "content-security-policy-report-only")
    uris = F.when(policy, F.split(F.coalesce(F.regexp_extract(value, r"(?i)(?:^|;)\s*report-uri\s+([^;]*)", 1), F.lit("")), r"\s+"))
    uris = uris.when(name == "report-to", F.regexp_extract_all(value, F.lit(r'"url"\s*:\s*"([^"]{1,500})"'), F.lit(1))).when(name == "reporting-endpoints", F.regexp_extract_all(value, F.lit(r'=\s*"([^"]{1,500})"'), F.lit(1)))
    urls = headers.select("domain", F.explode(uris).alias("u")).where(F.col("u").rlike("(?i)^https?://[^/?#]"))
    host = F.lower(F.regexp_extract("u", "(?i)^https?://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    path = F.regexp_replace(F.regexp_extract("u", "(?i)^https?://[^/?#]+([^?#]*)", 1), "/$", "")
    known = reduce(or_, [(host == c) | host.endswith(f".{c}") for c in COMMODITY_COLLECTORS])
    return urls.where(~known).select("domain", F.concat(host, path).alias("endpoint")).distinct()


def header_notes(headers: DataFrame, pages: DataFrame) -> DataFrame:
    """(domain, note, value): what is told besides the score. CORS for all origins, named a host default where markup says Cloudflare
    Pages; HTML comments; origins of scripts that the policy doesn't list. pages: (domain, technologies array, comments int, scripts array)."""
    both = _wide(headers).join(pages, "domain", "left")
    h = lambda n: F.element_at("h", F.lit(n))
    open_to_all = F.when(h("access-control-allow-origin") == "*", F.when(F.array_contains("technologies", "Cloudflare Pages"), "* (host default; override in _headers)").otherwise("*"))
    notes = F.when(F.col("comments") > 0, F.concat(F.col("comments").cast("string"), F.lit(" comment(s)")))
    csp = h("content-security-policy")
    listed = F.split(F.coalesce(directive(csp, "script-src"), directive(csp, "default-src"), F.lit("")), r"\s+")
    origin = lambda u: F.lower(F.regexp_extract(u, "(?i)^(https?://[^/?#]+)", 1))
    bare = lambda o: F.regexp_replace(o, "^https?://", "")

    def allowed(o: Column) -> Column:
        """By `*`, its scheme, its host with or without the scheme, or a wildcard above it."""
        wild = lambda t: F.regexp_replace(t, r"^(?:https?://)?\*", "")
        return F.exists(listed, lambda t: (t == "*") | (t == F.concat(F.substring_index(o, ":", 1), F.lit(":"))) | (F.regexp_replace(t, "/.*$", "") == bare(o)) | (F.regexp_extract(t, "^(https?://[^/]+)", 1) == o) | (t.rlike(r"^(?:https?://)?\*\.") & o.endswith(wild(t))))

    own = lambda o: (bare(o) == F.lower("domain")) | bare(o).endswith(F.concat(F.lit("."), F.lower("domain")))
    foreign = F.array_distinct(F.filter(F.transform(F.coalesce("scripts", F.array().cast("array<string>")), origin), lambda o: (o != "") & ~own(o)))
    unlisted = F.filter(foreign, lambda o: ~allowed(o))
    missing = F.when(csp.isNotNull() & (F.size(unlisted) > 0), F.array_join(F.array_sort(unlisted), ", "))
    rows = [("Access-Control-Allow-Origin", open_to_all), ("HTML comments", notes), ("CSP script allow-list", missing)]
    each = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(n).alias("note"), v.alias("value"))) for n, v in rows]))
    return both.select("domain", F.explode(each).alias("n")).select("domain", "n.*")


def seo_checks(pages: DataFrame, title=markup.title) -> DataFrame:
    """(page_id, check, weight, rating, points) of the checks that need only the page and its address (page_id, url, html); title:
    what reads the title whose letters count."""
    html, url = F.col("html"), F.col("url")
    title_len, about_len = F.length(F.coalesce(F.col("title"), F.lit(""))), F.length(F.coalesce(F.col("about"), F.lit("")))
    within = lambda n, low, high, slack: F.when(n == 0, "missing").when(n.between(low - slack, high + slack), "good").otherwise("warning")
    keys = lambda c: F.transform(c, lambda x: F.lower(x["key"]))
    og = F.size(F.array_intersect(keys(F.col("og")), F.array(*[F.lit(f"og:{k}") for k in ("title", "description", "image", "type")])))
    tw = keys(F.col("tw"))
    index = ~F.col("noindex")
    legal = F.regexp_replace("url", "[?#].*$", "").rlike(rf"(?i)/{LEGAL_SEGMENT}(?:/|\z)")
    checks = [
        ("Title", 15, within(title_len, 30, 60, 5), None, F.lit(True)),
        ("Meta Description", 15, within(about_len, 120, 160, 5), None, F.lit(True)),
        ("Canonical URL", 10, F.when(F.col("canonical").isNull(), "missing").otherwise("good"), None, index),
        ("Open Graph", 10, F.when(og == 4, "good").when(og > 0, "warning").otherwise("missing"), None, F.lit(True)),
        ("Twitter Card", 5, F.when(F.array_contains(tw, "twitter:card") & F.array_contains(tw, "twitter:title"), "good").when(F.size(tw) > 0, "warning").otherwise("missing"), None, F.lit(True)),
        ("Language", 5, F.when(F.col("lang").isNull(), "missing").otherwise("good"), None, F.lit(True)),
        ("Viewport", 5, F.when(F.col("viewport").isNull(), "missing").otherwise("good"), None, F.lit(True)),
        ("Structured Data", 10, F.when(F.col("structured"), "good").otherwise("missing"), None, index & ~legal),
        ("Hreflang", 5, F.when(F.col("hreflang"), "good").otherwise("warning"), 0, index),
        ("HTTPS", 5, F.when(F.lower(url).startswith("https://"), "good").otherwise("warning"), 0, F.lit(True)),
    ]
    seen = pages.select(
        "page_id", "url", title(html).alias("title"), markup.meta(html, "description").alias("about"), markup.canonical(html).alias("canonical"),
        markup.cards(html, "property", "og").alias("og"), markup.cards(html, "name", "twitter").alias("tw"), markup.first(html, r"""(?i)<html[^>]+lang=["']([^"']+)["']""").alias("lang"),
        markup.meta(html, "viewport").alias("viewport"), html.contains("application/ld+json").alias("structured"), markup.noindex(html).alias("noindex"),
        html.rlike(r"(?i)<link[^>]+hreflang\s*=").alias("hreflang"),
    )
    half = lambda w, zero: F.lit(w // 2 if zero is None else zero)
    rows = [F.when(on, F.struct(F.lit(n).alias("check"), F.lit(w).alias("weight"), r.alias("rating"), half(w, zero).alias("some"))) for n, w, r, zero, on in checks]
    out = seen.select("page_id", F.explode(F.array_compact(F.array(*rows))).alias("c")).select("page_id", "c.*")
    points = F.when(F.col("rating") == "good", F.col("weight")).when(F.col("rating") == "warning", F.col("some")).otherwise(0)
    return out.select("page_id", "check", "weight", "rating", points.alias("points"))


def seo_score(pages: DataFrame, title=markup.title) -> DataFrame:
    sums = seo_checks(pages, title).groupBy("page_id").agg(F.sum("points").alias("p"), F.sum("weight").alias("m"))
    return sums.select("page_id", percent(F.col("p"), F.col("m")).alias("score"))


def site_seo_checks(sites: DataFrame) -> DataFrame:
    """(domain, check, weight, rating, points) of checks that need more than a page: robots.txt, sitemap, and HTTPS by the status that
    was seen. sites: (domain, robots_scanned, robots, sitemaps int, status, scheme); without a status HTTPS isn't evaluated."""
    have = lambda c: F.when(c, "good").otherwise("missing")
    ok = F.col("status").between(200, 399)
    https = F.when(ok & (F.coalesce("scheme", F.lit("https")) != "http"), "good").otherwise("warning")
    checks = [
        ("robots.txt", 5, F.col("robots_scanned"), have(F.coalesce(F.col("robots") != "", F.lit(False)))), ("Sitemap", 10, F.col("robots_scanned"), have(F.coalesce(F.col("sitemaps") > 0, F.lit(False)))),
        ("HTTPS", 5, F.coalesce(F.col("status") > 0, F.lit(False)), https),
    ]
    rows = F.array_compact(F.array(*[F.when(on, F.struct(F.lit(n).alias("check"), F.lit(w).alias("weight"), r.alias("rating"))) for n, w, on, r in checks]))
    out = sites.select("domain", F.explode(rows).alias("c")).select("domain", "c.*")
    return out.withColumn("points", F.when(F.col("rating") == "good", F.col("weight")).otherwise(0))


def seo_skips(pages: DataFrame) -> DataFrame:
    """(page_id, check, reason) of checks that don't apply to a page."""
    legal = F.regexp_replace("url", "[?#].*$", "").rlike(rf"(?i)/{LEGAL_SEGMENT}(?:/|\z)")
    reason = lambda names, text: F.array(*[F.struct(F.lit(n).alias("check"), F.lit(text).alias("reason")) for n in names])
    rows = F.when(markup.noindex(F.col("html")), reason(("Canonical URL", "Hreflang", "Structured Data"), "noindex")).when(legal, reason(("Structured Data",), "legal/utility page"))
    return pages.select("page_id", F.explode(rows).alias("s")).select("page_id", "s.*")


def _network(value: Column, table) -> Column:
    """struct<name, adult> of the first network whose pattern the value matches."""
    out = None
    for name, adult, pattern in table:
        hit, one = value.rlike(f"(?i){pattern}"), F.struct(F.lit(name).alias("name"), F.lit(adult).alias("adult"))
        out = F.when(hit, one) if out is None else out.when(hit, one)
    return out


def keyword_rules(low: bool = True) -> list[tuple]:
    """(pattern, keyword, severity, place) of the keywords, those of low severity only if asked for."""
    some = [(p, severity) for severity, patterns in KEYWORDS.items() if low or severity != "low" for p in patterns]
    return [(rf"(?i)\b(?:{p})\b", p, severity, k) for k, (p, severity) in enumerate(some)]


def keyword_hits(texts: DataFrame, text: str, low: bool = True) -> DataFrame:
    """Rows of texts with (keyword, severity, place, hits, first) of each keyword in the column `text`."""
    rules = keyword_rules(low)
    tried = matcher.tried(texts, text, rules, "pattern string, keyword string, severity string, place int", inner=[r[1] for r in rules])
    # Without the edges of words a pattern costs less, and few texts match it.
    tried = tried.where(F.rlike(F.col(text), F.concat(F.lit("(?i)"), F.col("keyword"))))
    hits = tried.withColumn("hits", F.regexp_count(F.col(text), F.col("regex")).cast("long")).where("hits > 0")
    return hits.withColumn("first", F.expr(f"regexp_extract({text}, regex, 0)")).drop("rule", "regex", "pattern")


def keyword_signals(pages: DataFrame) -> DataFrame:
    """(page_id, pattern, severity, hits, first) of each keyword in the visible text."""
    texts = pages.select("page_id", markup.visible_text(F.col("html")).alias("text"))
    return keyword_hits(texts, "text").select("page_id", F.col("keyword").alias("pattern"), "severity", "hits", "first")


def _links(html: Column) -> Column:
    """array<struct<url, network, adult>> of links to networks and of a site's own redirects (network null)."""
    known = F.transform(F.array_distinct(markup.every(html, markup.LISTS["anchor"])), lambda u: F.struct(u.alias("url"), _network(u, AFFILIATES).alias("n")))
    some = F.filter(known, lambda x: x["n"].isNotNull() | x["url"].rlike(f"(?i){REDIRECT}"))
    return F.transform(some, lambda x: F.struct(x["url"].alias("url"), x["n"]["name"].alias("network"), F.coalesce(x["n"]["adult"], F.lit(False)).alias("adult")))


def affiliates(pages: DataFrame) -> DataFrame:
    """(page_id, url, network, adult) of outgoing links to networks and of a site's own redirects (network null)."""
    return pages.select("page_id", F.explode(_links(F.col("html"))).alias("x")).select("page_id", "x.*")


def _scripts(html: Column) -> Column:
    """array<struct<src, network, adult>>: the first matching network of each script source."""
    known = F.transform(markup.every(html, markup.LISTS["script_src"]), lambda u: F.struct(u.alias("src"), _network(u, AD_NETWORKS).alias("n")))
    return F.transform(F.filter(known, lambda x: x["n"].isNotNull()), lambda x: F.struct(x["src"].alias("src"), x["n"]["name"].alias("network"), x["n"]["adult"].alias("adult")))


def _inline(html: Column, sources: Column) -> Column:
    """array<struct<src, network, adult>>: each network once that inline scripts name and no script source has; src is `(inline)`."""
    text = F.array_join(F.regexp_extract_all(html, F.lit(r"(?i)<script(?![^>]*src)[^>]*>([\s\S]*?)</script>"), F.lit(1)), "\n")
    named = lambda t: F.array(*[F.when(t.rlike(f"(?i){p}"), F.struct(F.lit("(inline)").alias("src"), F.lit(n).alias("network"), F.lit(a).alias("adult"))) for n, a, p in AD_NETWORKS])
    none = F.array().cast("array<struct<src:string,network:string,adult:boolean>>")
    rows = markup.let(text, lambda t: F.when(t != "", F.array_compact(named(t))).otherwise(none))
    return F.filter(rows, lambda x: ~F.exists(sources, lambda y: y["network"] == x["network"]))


def ad_networks(pages: DataFrame) -> DataFrame:
    """(page_id, src, network, adult) of script sources, then of inline scripts."""
    seen = pages.select("page_id", "html", _scripts(F.col("html")).alias("s"))
    return seen.select("page_id", F.explode(F.concat("s", _inline(F.col("html"), F.col("s")))).alias("x")).select("page_id", "x.*")


def content_signals(pages: DataFrame) -> DataFrame:
    """(page_id, type, value, severity, weight) of what marks content as adult, in (page_id, host, html): keywords, a keyword in the
    host's name, image texts, the rating tag, the RTA label, affiliate links and ad networks. The texts in which keywords are
    looked for are rows: the visible one, the host's name, each image's."""
    html = F.col("html")
    critical = F.lit("critical")
    row = lambda kind, value, severity: F.struct(F.lit(kind).alias("type"), value.alias("value"), severity.alias("severity"))
    rating = F.regexp_extract(html, r"""(?i)<meta[^>]+name=['"]rating['"][^>]+content=['"]([^'"]+)['"]""", 1)
    seen = pages.select("page_id", "html", _scripts(html).alias("s"))
    parts = [
        F.array(row("meta_rating", rating, F.when(rating.rlike(ADULT_RATING), critical))),
        F.array(row("rta_label", F.lit("RTA-5042-1996-1400-1577-RTA"), F.when(html.contains("RTA-5042") & html.rlike(java(RTA_LABEL)), critical))),
        F.transform(F.filter(_links(html), lambda x: x["adult"]), lambda x: row("affiliate", F.concat_ws(": ", x["network"], F.substring(x["url"], 1, 80)), critical)),
        F.transform(F.filter(F.concat("s", _inline(html, F.col("s"))), lambda x: x["adult"]), lambda x: row("ad_network", F.concat_ws(": ", x["network"], F.substring(x["src"], 1, 80)), critical)),
    ]
    marks = seen.select("page_id", F.explode(F.filter(F.concat(*parts), lambda x: x["severity"].isNotNull())).alias("x")).select("page_id", "x.*", F.lit(1.0).alias("weight"))

    text = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("text"))
    alts = F.transform(F.regexp_extract_all(html, F.lit(r"""(?i)alt=['"]([^'"]+)['"]"""), F.lit(1)), lambda x: text("image_alt", x))
    times = F.when(F.col("hits") >= 10, 2.0).when(F.col("hits") >= 3, 1.5).otherwise(1.0)
    words = keyword_hits(pages.select("page_id", F.lit("keyword").alias("type"), markup.visible_text(html).alias("text")), "text")
    words = words.select("page_id", "type", F.concat(F.col("first"), F.lit(" (×"), F.col("hits").cast("string"), F.lit(")")).alias("value"), "severity", times.alias("weight"))
    # Of a short text the first keyword counts, those of low severity aside.
    texts = pages.select("page_id", "host", F.posexplode(F.concat(F.array(text("domain_name", F.regexp_replace("host", "[.-]", " "))), alts)).alias("n", "t"))
    hits = keyword_hits(texts.select("page_id", "host", "n", "t.type", "t.text"), "text", low=False)
    short = hits.groupBy("page_id", "n", "type").agg(F.min_by(F.struct("severity", "host", "text"), "place").alias("x"))
    value = F.when(F.col("type") == "domain_name", F.col("x.host")).otherwise(F.substring("x.text", 1, 60))
    return words.unionByName(short.select("page_id", "type", value.alias("value"), "x.severity", F.lit(1.0).alias("weight"))).unionByName(marks)


def adult_score(pages: DataFrame, threshold: int = 30) -> DataFrame:
    """(page_id, score, is_adult): weights of the content signals, more for repeated keywords; at most 100."""
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHT.items() for x in kv]), F.col("severity"))
    total = content_signals(pages).groupBy("page_id").agg(F.sum(weight * F.col("weight")).alias("w"))
    score = F.least(F.lit(100), F.floor(F.coalesce("w", F.lit(0.0)) + 0.5)).cast("int")
    return pages.select("page_id").join(total, "page_id", "left").select("page_id", score.alias("score"), (score >= threshold).alias("is_adult"))


def classify(scores: DataFrame, sites: DataFrame, errors: DataFrame) -> DataFrame:
    """(domain, classified, error, is_adult, score, cluster, violation): sites (domain, cluster) with their content score (domain,
    score, is_adult); a site without one isn't clean but unclassified, with its error (domain, error)."""
    both = sites.join(scores, "domain", "left").join(errors, "domain", "left")
    known = F.col("score").isNotNull()
    adult = F.coalesce("is_adult", F.lit(False))
    clean = F.col("cluster").isNotNull() & ~F.lower(F.trim("cluster")).startswith("adult")
    return both.select("domain", known.alias("classified"), F.when(~known, F.coalesce("error", F.lit("no HTML body"))).alias("error"), adult.alias("is_adult"), F.coalesce("score", F.lit(0)).alias("score"), "cluster", (clean & adult).alias("violation"))


def dmarc_fix(domains: DataFrame) -> DataFrame:
    """(domain, fix) from (domain, dmarc, contact): the record to publish where the policy isn't enforced in full. Reports go where
    the record sends them now, else to the contact (see `signals.contacts`), else to the postmaster; contact may be left out."""
    d = records.dmarc(F.col("dmarc"))
    known = [F.lower(F.get(d["rua"], F.lit(0))), *([F.col("contact")] if "contact" in domains.columns else [])]
    rua = F.coalesce(*known, F.concat(F.lit("postmaster@"), F.col("domain")))
    txt = lambda policy, more="": F.concat(F.lit("v=DMARC1; p="), policy, F.lit(f"{more}; rua=mailto:"), rua)
    strict = d["policy"].isin("reject", "quarantine")
    fix = F.when(F.coalesce(strict, F.lit(False)), F.when(d["pct"] < 100, txt(d["policy"], "; pct=100"))).otherwise(txt(F.lit("quarantine")))
    return domains.select("domain", fix.alias("fix")).where("fix IS NOT NULL")


def email_auth(domains: DataFrame) -> DataFrame:
    """(domain, check, rating) from (domain, spf, dmarc, dkim): raw records, null where none is published; dkim counts keys."""
    s, d = records.spf(F.col("spf")), records.dmarc(F.col("dmarc"))
    rated = domains.select("domain", "spf", "dmarc", "dkim", s.alias("s"), d.alias("d"))
    end, policy = F.col("s.all"), F.col("d.policy")
    lookups = F.size("s.includes") + F.when(F.col("s.redirect").isNotNull(), 1).otherwise(0)
    spf = F.when(F.col("spf").isNull(), "missing").when(end == "+all", "bad").when(end.isNull() | (end == "?all"), "warning").when(lookups > 10, "warning").otherwise("good")
    dmarc = F.when(F.col("dmarc").isNull(), "missing").when(policy.isin("reject", "quarantine"), F.when(F.col("d.pct") < 100, "warning").otherwise("good")).when(policy == "none", "warning").otherwise("bad")
    dkim = F.when(F.col("dkim") > 0, "good").otherwise("warning")
    checks = F.array(*[F.struct(F.lit(n).alias("check"), r.alias("rating")) for n, r in (("SPF", spf), ("DMARC", dmarc), ("DKIM", dkim))])
    return rated.select("domain", F.explode(checks).alias("c")).select("domain", "c.*")


def site_findings(checks: DataFrame, scope: str) -> DataFrame:
    """(domain, id, severity) of checks (domain, check, rating) that aren't good."""
    slug = F.regexp_replace(F.regexp_replace(F.lower("check"), "[^a-z0-9]+", "-"), "^-|-$", "")
    severity = F.when(F.col("rating").isin("missing", "bad"), "crit").otherwise("warn")
    return checks.where("rating <> 'good'").select("domain", F.concat(F.lit(f"{scope}:"), "domain", F.lit("/"), slug).alias("id"), severity.alias("severity"))


def technologies(pages: DataFrame) -> DataFrame:
    """(page_id, name, confidence) by marks in the markup; the first mark of a technology that is there counts."""
    html, gen = F.col("html"), F.lower(F.coalesce(F.col("generator"), F.lit("")))
    has = lambda *parts: [html.contains(p) for p in parts]
    utilities = F.regexp_count(html, F.lit(java(r"\b(?:flex|grid|bg-|text-|px-|py-|mt-|mb-|rounded-|shadow-|hover:|sm:|md:|lg:|xl:)[A-Za-z0-9_]+")))
    styled = html.rlike(r'class="[^"]*(?:flex|grid|bg-|text-|px-|py-|mt-|mb-|rounded|shadow|hover:|sm:|md:|lg:)[^"]*"')
    marks = [
        ("Astro", [(has("/_astro/")[0], 95), (gen.contains("astro"), 100)]), ("Next.js", [(has("/_next/")[0], 95)]), ("Nuxt", [(has("/_nuxt/")[0], 95), (has("__nuxt")[0], 80)]),
        ("Gatsby", [(gen.contains("gatsby"), 100), (html.contains("gatsby-") & html.contains("___gatsby"), 90)]), ("Hugo", [(gen.contains("hugo"), 100)]), ("Jekyll", [(gen.contains("jekyll"), 100)]),
        ("WordPress", [(gen.contains("wordpress"), 100), (html.contains("/wp-content/") | html.contains("/wp-includes/"), 95)]),
        ("Drupal", [(gen.contains("drupal"), 100), (html.contains("/sites/default/files/"), 80)]), ("Squarespace", [(html.contains("squarespace.com"), 90)]),
        ("Webflow", [(gen.contains("webflow"), 100), (html.contains("assets.website-files.com"), 85)]), ("React", [(html.contains("__react") | html.contains("data-reactroot"), 85)]),
        ("Vue.js", [(html.rlike("data-v-[a-f0-9]"), 85), (html.contains("__vue_app__"), 90)]), ("Svelte", [(html.rlike("svelte-[a-z0-9]") & html.contains('class="s-'), 80)]),
        ("Tailwind CSS", [(styled & (utilities > 20), 90), (styled & (utilities > 5), 70)]),
    ]

    def chain(branches):
        out = F.when(branches[0][0], branches[0][1])
        for cond, points in branches[1:]:
            out = out.when(cond, points)
        return out

    rows = F.array(*[F.struct(F.lit(n).alias("name"), chain(b).alias("confidence")) for n, b in marks])
    seen = pages.withColumn("generator", markup.meta(html, "generator"))
    return seen.select("page_id", F.explode(F.filter(rows, lambda r: r["confidence"].isNotNull())).alias("tech")).select("page_id", "tech.*")


def header_technologies(headers: DataFrame) -> DataFrame:
    """(domain, name, confidence) by response headers; the first mark of a technology that is there counts."""
    h = lambda n: F.element_at("h", F.lit(n))
    there = lambda n: F.coalesce(h(n), F.lit("")) != ""
    part = lambda n, x: F.coalesce(h(n).contains(x), F.lit(False))
    server = F.lower(F.coalesce(h("server"), F.lit("")))
    marks = [
        ("Next.js", F.when(there("x-nextjs-cache") | part("x-powered-by", "Next.js"), 100)), ("Drupal", F.when(there("x-drupal-cache"), 100)),
        ("Cloudflare", F.when((h("server") == "cloudflare") | there("cf-ray"), 100)), ("Vercel", F.when(there("x-vercel-id") | (h("server") == "Vercel"), 100)),
        ("Netlify", F.when(there("x-nf-request-id") | part("server", "Netlify"), 100)), ("AWS CloudFront", F.when(there("x-amz-cf-id"), 100).when(part("via", "cloudfront"), 90)),
        ("Fastly", F.when(part("x-served-by", "cache-"), 85).when(part("via", "varnish"), 60)), ("GitHub Pages", F.when(h("server") == "GitHub.com", 100)),
        ("NEL (Network Error Logging)", F.when(there("nel") & there("report-to"), 100).when(there("nel"), 90)), ("Nginx", F.when(server.startswith("nginx"), 100)),
        ("Apache", F.when(server.startswith("apache"), 100)), ("Caddy", F.when(server == "caddy", 100)),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("name"), c.alias("confidence")) for n, c in marks])
    return _wide(headers).select("domain", F.explode(F.filter(rows, lambda r: r["confidence"].isNotNull())).alias("tech")).select("domain", "tech.*")


def hosting(sites: DataFrame) -> DataFrame:
    """(domain, name, confidence) of Cloudflare Pages from (domain, h map of headers, html, cname array): marks add up."""
    h = lambda n: F.coalesce(F.element_at("h", F.lit(n)), F.lit(""))
    named = F.coalesce(F.exists("cname", lambda c: c.endswith(".pages.dev")), F.lit(False))
    static = F.coalesce(F.col("html").rlike("/_astro/|/build/|/assets/"), F.lit(False))
    base = F.when(named, 95).when(static & (h("x-powered-by") == ""), 60).otherwise(0)
    cached = F.when((h("cf-cache-status") != "") & (base > 0), F.least(F.lit(100), base + 10)).otherwise(base)
    shut = (h("cross-origin-opener-policy") != "") | (h("cross-origin-embedder-policy") != "") | (h("cross-origin-resource-policy") != "")
    points = F.when(shut & static, F.least(F.lit(100), cached + 15)).otherwise(cached)
    there = (h("cf-ray") != "") & (h("server") == "cloudflare") & (points > 0)
    return sites.where(there).select("domain", F.lit("Cloudflare Pages").alias("name"), points.alias("confidence"))


def ranked_technologies(found: DataFrame) -> DataFrame:
    """(domain, name, confidence, rank) of detections from markup, headers and records (domain, name, confidence): of a name the surest,
    and each site's in order of confidence."""
    best = found.groupBy("domain", "name").agg(F.max("confidence").alias("confidence"))
    place = F.array_position(F.array(*map(F.lit, TECHNOLOGIES)), F.col("name"))  # equal ones in the order of the registry, others behind
    order = Window.partitionBy("domain").orderBy(F.col("confidence").desc(), F.when(place > 0, place).otherwise(len(TECHNOLOGIES) + 1), "name")
    return best.withColumn("rank", F.row_number().over(order))
