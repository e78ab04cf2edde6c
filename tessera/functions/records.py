"""Column expressions over DNS records, well-known files and WHOIS text. `as_of` is a date, so that results don't drift."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.markup import let
from tessera.registry import ONE_CLICK_DNSSEC, REDIRECT_PATHS, STATUS_TEXTS


def _terms(raw: Column) -> Column:
    """SPF terms after the version, lower-cased, without their qualifiers but for `all`."""
    return F.filter(F.filter(F.split(F.lower(F.trim(raw)), r"\s+"), lambda x: x != ""), lambda _, i: i > 0)


def spf(raw: Column) -> Column:
    """struct<includes, ip4, ip6, redirect, all>; the last `all` and redirect count."""
    terms = _terms(raw)
    bare = F.transform(terms, lambda t: F.regexp_replace(t, "^[+?~-]", ""))
    of = lambda prefix: F.transform(F.filter(bare, lambda t: t.startswith(prefix)), lambda t: F.substr(t, F.lit(len(prefix) + 1)))
    last = lambda a: F.get(a, F.size(a) - 1)
    ends = F.filter(terms, lambda t: t.rlike(r"^[+?~-]?all\z"))
    end = last(ends)
    return F.struct(of("include:").alias("includes"), of("ip4:").alias("ip4"), of("ip6:").alias("ip6"), last(of("redirect=")).alias("redirect"), F.when(end == "all", "+all").otherwise(end).alias("all"))


def _tag(raw: Column, key: str) -> Column:
    found = F.regexp_extract(raw, rf"(?i)(?:^|;)\s*{key}\s*=\s*([^;]*)", 1)
    return F.when(F.trim(found) != "", F.trim(found))


def dmarc(raw: Column) -> Column:
    """struct<policy, subdomain_policy, pct, rua, ruf>."""
    uris = lambda key: F.array_distinct(F.transform(F.filter(F.split(F.coalesce(_tag(raw, key), F.lit("")), ","), lambda x: F.trim(x) != ""), lambda x: F.lower(F.regexp_replace(F.regexp_replace(F.trim(x), "(?i)^mailto:", ""), r"![0-9]+[kmgt]?$", ""))))
    return F.struct(F.lower(_tag(raw, "p")).alias("policy"), F.lower(_tag(raw, "sp")).alias("subdomain_policy"), _tag(raw, "pct").try_cast("int").alias("pct"), uris("rua").alias("rua"), uris("ruf").alias("ruf"))


def label(text: Column, *names: str) -> Column:
    """The value of the first of these labels that a `label: value` text has."""
    found = [F.regexp_extract(text, rf"(?im)^[ \t]*{n}[ \t]*:[ \t]*([^\r\n]*)", 1) for n in names]
    return F.coalesce(*[F.when(F.trim(f) != "", F.trim(f)) for f in found])


def whois(text: Column) -> Column:
    servers = F.regexp_extract_all(text, F.lit(r"(?im)^[ \t]*(?:name server|nserver)[ \t]*:[ \t]*([^\s]+)"), F.lit(1))
    return F.struct(
        label(text, "registrar", "sponsoring registrar").alias("registrar"),
        label(text, "creation date", "created date", "registration date", "created", "registered on").alias("created"),
        label(text, "updated date", "last updated").alias("updated"),
        label(text, "registry expiry date", "expiry date", "expiration date", "registrar registration expiration date", "expires", "paid-till").alias("expires"),
        F.array_distinct(F.transform(servers, F.lower)).alias("nameservers"),
        label(text, "registrant organization", "registrant organisation", "org").alias("organisation"),
        label(text, "registrant country", "country").alias("country"),
        label(text, "dnssec").alias("dnssec"),
    )


def dnssec_provider(nameservers: Column) -> Column:
    """Of the first nameserver of such a provider: the one that signs a zone with one click."""

    def named(n: Column) -> Column:
        host = F.regexp_replace(F.lower(F.trim(n)), r"\.$", "")
        return F.coalesce(*[F.when((host == domain) | host.endswith(f".{domain}"), F.lit(name)) for domain, name in ONE_CLICK_DNSSEC])

    return F.get(F.array_compact(F.transform(nameservers, named)), F.lit(0))


def status_text(status: Column) -> Column:
    """What an HTTP error status means; null below 400."""
    known = F.element_at(F.create_map(*[F.lit(x) for kv in STATUS_TEXTS.items() for x in kv]), status)
    return F.when(status >= 400, F.coalesce(known, F.when(status >= 500, "server error").otherwise("client error")))


def stripped_path(text: Column) -> Column:
    """Path, query and fragment of an address with or without a scheme; empty if there is none but slashes."""
    rest = F.regexp_extract(F.regexp_replace(text, "(?i)^https?://", ""), r"[/?#][\s\S]*$", 0)
    return F.when(rest.rlike("^/+$"), "").otherwise(rest)


def domain_url(text: Column) -> Column:
    return F.when(text.rlike("^https?://"), text).otherwise(F.concat(F.lit("https://"), text))


def explicit_http(url: Column) -> Column:
    """Whether a target was given with http://, so that neither TLS nor WHOIS is expected of it."""
    return F.coalesce(url.startswith("http://"), F.lit(False))


def days_until(when: Column, as_of: str) -> Column:
    """Whole days, rounded down, from midnight of as_of; null for what is no date."""
    return F.floor((F.unix_timestamp(F.try_to_timestamp(when)) - F.unix_timestamp(F.to_timestamp(F.lit(as_of)))) / 86400).cast("int")


def normal_hash(text: Column) -> Column:
    return F.substring(F.md5(F.trim(F.regexp_replace(text, r"\s+", " "))), 1, 12)


def publishers(ads_txt: Column) -> Column:
    lines = F.filter(F.transform(F.split(ads_txt, "\r?\n"), F.trim), lambda x: (x != "") & ~x.startswith("#"))
    return F.array_distinct(F.filter(F.transform(lines, lambda x: F.trim(F.get(F.split(x, ","), F.lit(1)))), lambda x: x.isNotNull() & (x != "")))


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _private_v4(a: Column, b: Column) -> Column:
    return (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31))
        | ((a == 192) & b.isin(0, 168)) | ((a == 198) & b.isin(18, 19))
    )


def groups(ip: Column) -> Column:
    """The eight numbers of an IPv6 address, with `::` filled up and a dotted end made two numbers; null if it is none."""

    def numbers(octets: Column) -> Column:
        two = lambda i: F.lower(F.hex((F.get(octets, F.lit(i)) * 256 + F.get(octets, F.lit(i + 1))).cast("long")))
        return F.concat(two(0), F.lit(":"), two(2))

    def undotted(text: Column) -> Column:
        parts = F.transform(F.split(F.substring_index(text, ":", -1), r"\."), lambda x: x.try_cast("int"))
        return F.when(text.rlike(rf"^[0-9a-f:]*:{V4}$"), F.concat(F.regexp_extract(text, rf"^([0-9a-f:]*:){V4}$", 1), let(parts, numbers))).otherwise(text)

    def filled(halves: Column) -> Column:
        named = lambda i: F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda x: x != "")
        one = lambda left, right, fill: F.when(F.size(halves) == 1, left).when((F.size(halves) == 2) & (fill >= 0), F.concat(left, F.array_repeat(F.lit("0"), fill), right))
        return let(named(0), lambda left: let(named(1), lambda right: let(8 - F.size(left) - F.size(right), lambda fill: one(left, right, fill))))

    def checked(full: Column) -> Column:
        valid = (F.size(full) == 8) & F.forall(full, lambda x: x.rlike("^[0-9a-f]{1,4}$"))
        return F.when(valid, F.transform(full, lambda x: F.conv(x, 16, 10).cast("int")))

    text = let(F.lower(F.substring_index(ip, "%", 1)), undotted)
    return let(let(F.split(text, "::", -1), filled), checked)


def is_private(ip: Column) -> Column:
    """Whether an address must not be fetched: private, loopback, link-local, shared, reserved or multicast, or no address at all."""
    part = F.transform(F.split(ip, r"\."), lambda x: x.try_cast("int"))
    v4 = _private_v4(F.get(part, F.lit(0)), F.get(part, F.lit(1)))
    return let(groups(ip), lambda g: _is_private(ip, v4, g))


def _is_private(ip: Column, v4: Column, g: Column) -> Column:
    at = lambda i: F.get(g, F.lit(i))
    zero = lambda n: F.forall(F.slice(g, 1, n), lambda x: x == 0)
    mapped = (zero(5) & (at(5) == 0xFFFF)) | zero(6)
    inner = _private_v4(F.shiftright(at(6), 8), at(6).bitwiseAND(F.lit(0xFF)))
    wide = (at(0).bitwiseAND(F.lit(0xFE00)) == 0xFC00) | (at(0).bitwiseAND(F.lit(0xFFC0)) == 0xFE80) | (at(0).bitwiseAND(F.lit(0xFF00)) == 0xFF00)
    v6 = F.when(g.isNull(), True).when(zero(7) & at(7).isin(0, 1), True).when(mapped, inner).otherwise(wide)
    return F.when(ip.isNull(), True).when(ip.rlike(rf"^{V4}$"), v4).when(ip.contains(":"), v6).otherwise(True)


def fetch_allowed(url: Column, target_host: Column, answers: Column) -> Column:
    """Whether a page may make us fetch a URL: http(s) only; the target's own host; else no private address among the answers
    (addresses that its host resolves to; a literal address stands for itself)."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]+)", 1)), r"^\[|\]$", "")
    literal = host.rlike(rf"^{V4}$") | host.contains(":")
    resolved = F.coalesce(F.size(answers), F.lit(0)) > 0
    public = F.when(literal, ~is_private(host)).otherwise(resolved & F.coalesce(F.forall(answers, lambda x: ~is_private(x)), F.lit(False)))
    return F.coalesce((host != "") & ((host == F.lower(target_host)) | public), F.lit(False))


def first_txt(txts: Column, pattern: str) -> Column:
    """The first record that matches."""
    return F.get(F.filter(txts, lambda t: t.rlike(pattern)), F.lit(0))


def spf_record(txts: Column) -> Column:
    return first_txt(txts, r"(?i)^\s*v=spf1(?![A-Za-z0-9_])")


def dmarc_record(txts: Column) -> Column:
    return first_txt(txts, r"(?i)^\s*v=dmarc1(?![A-Za-z0-9_])")


def dkim_keys(txts: Column) -> Column:
    """Records that carry a key; those with an empty p= are revoked or parked."""
    return F.filter(txts, lambda t: t.rlike(r"(?i)v=dkim1(?![A-Za-z0-9_])") & t.rlike("(?i)p=[a-z0-9+/]"))


def verifications(txts: Column) -> Column:
    """struct<google, microsoft, facebook>: the first token of each."""
    one = lambda p: F.get(F.filter(F.transform(txts, lambda t: F.regexp_extract(t, p, 1)), lambda x: x != ""), F.lit(0))
    return F.struct(
        one("(?i)^google-site-verification=([A-Za-z0-9_-]+)").alias("google"), one("(?i)^ms=([A-Za-z0-9_-]+)").alias("microsoft"),
        one("(?i)^facebook-domain-verification=([a-z0-9]+)").alias("facebook"),
    )


CAA_TAGS = ("issue", "issuewild", "iodef", "contactemail", "contactphone")


def caa(record: Column) -> Column:
    """`tag value` of the first tag of a CAA record (map<string,string>) that has a value."""
    return F.coalesce(*[F.when(F.element_at(record, F.lit(t)) != "", F.concat(F.lit(f"{t} "), F.element_at(record, F.lit(t)))) for t in CAA_TAGS])


def distinguished_name(parts: Column) -> Column:
    """`k=v, k=v` of array<struct<k, v array<string>>>; several values are joined by a plus sign."""
    return F.array_join(F.transform(parts, lambda e: F.concat(e["k"], F.lit("="), F.array_join(e["v"], "+"))), ", ")


def san(text: Column) -> Column:
    """Names of a certificate's subjectAltName text."""
    names = F.transform(F.split(text, ","), lambda x: F.regexp_replace(F.trim(x), "^DNS:", ""))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(names)


def valid_domain(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?i)^[a-z0-9]([a-z0-9.-]*[a-z0-9])?\.[a-z]{2,}$"), F.lit(False))


def rdap(text: Column) -> Column:
    """struct<registrar, created, updated, expires, nameservers, organisation, country, dnssec> of an RDAP answer; null if it is no JSON."""
    card = "array<struct<roles:array<string>, handle:string, vcardArray:array<variant>>>"
    doc = F.try_parse_json(text)
    entities = F.try_variant_get(doc, "$.entities", card)
    role = lambda r: F.get(F.filter(entities, lambda e: F.array_contains(e["roles"], r)), F.lit(0))

    def field(entity: Column, name: str) -> Column:
        rows = F.try_variant_get(F.get(entity["vcardArray"], F.lit(1)), "$", "array<array<variant>>")
        hit = F.get(F.filter(rows, lambda r: F.try_variant_get(F.get(r, F.lit(0)), "$", "string") == name), F.lit(0))
        return F.get(hit, F.lit(3))

    word = lambda entity, name: F.try_variant_get(field(entity, name), "$", "string")
    event = lambda what: F.get(F.filter(F.try_variant_get(doc, "$.events", "array<struct<eventAction:string, eventDate:string>>"), lambda e: e["eventAction"] == what), F.lit(0))["eventDate"]
    servers = F.transform(F.try_variant_get(doc, "$.nameservers", "array<struct<ldhName:string>>"), lambda n: F.lower(n["ldhName"]))
    signed = F.try_variant_get(doc, "$.secureDNS.delegationSigned", "boolean")
    country = F.try_variant_get(field(role("registrant"), "adr"), "$[6]", "string")
    return F.when(
        doc.isNotNull(),
        F.struct(
            F.coalesce(word(role("registrar"), "fn"), role("registrar")["handle"]).alias("registrar"), event("registration").alias("created"), event("last changed").alias("updated"),
            event("expiration").alias("expires"), F.array_distinct(F.array_compact(F.coalesce(servers, F.array().cast("array<string>")))).alias("nameservers"),
            F.coalesce(word(role("registrant"), "org"), word(role("registrant"), "fn")).alias("organisation"), F.when(country != "", country).alias("country"),
            F.when(F.try_variant_get(doc, "$.secureDNS", "variant").isNotNull(), F.when(signed, "signed").otherwise("unsigned")).alias("dnssec"),
        ),
    )


def url_origin(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, "(?i)^(https?://[^/?#]+)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """Path of an absolute URL, `/` if it has none; other text as it is."""
    path = F.regexp_extract(url, "(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(url.rlike("(?i)^[a-z][a-z0-9+.-]*://"), F.when(path == "", "/").otherwise(path)).otherwise(url)


def resolve_url(base: Column, ref: Column) -> Column:
    """An absolute http(s) URL of a reference on a page: absolute, scheme-relative, rooted, or relative to the page's folder; else null."""
    folder = F.when(F.regexp_replace(base, "[?#].*$", "").rlike("(?i)^https?://[^/]+$"), F.concat(F.regexp_replace(base, "[?#].*$", ""), F.lit("/"))).otherwise(F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), "[^/]*$", ""))
    full = (
        F.when(ref.rlike("(?i)^https?://"), ref).when(ref.rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None)).when(ref.startswith("//"), F.concat(F.regexp_extract(base, "(?i)^(https?:)", 1), ref))
        .when(ref.startswith("/"), F.concat(url_origin(base), ref)).when(ref.startswith("#") | (ref == ""), F.regexp_replace(base, "#.*$", "")).when(ref.startswith("?"), F.concat(F.regexp_replace(base, "[?#].*$", ""), ref)).otherwise(F.concat(folder, ref))
    )
    return F.regexp_replace(F.regexp_replace(full, r"/(?:\./)+", "/"), r"(?<=[^/:])/[^/.][^/]*/\.\./", "/")


def file_text(body: Column) -> Column:
    """A well-known file's text; null for HTML error pages."""
    return F.when(~F.ltrim(F.regexp_replace(body, r"^\s+", "")).rlike("^(?:<!|<html)"), body)


def sitemap_urls(robots: Column) -> Column:
    return F.regexp_extract_all(robots, F.lit(r"(?i)Sitemap:\s*(\S+)"), F.lit(1))


def redirect_paths(robots: Column) -> Column:
    """Disallowed paths that are affiliate redirects."""
    paths = F.regexp_extract_all(robots, F.lit(r"(?im)^Disallow:\s*(\S+)"), F.lit(1))
    known = lambda p: reduce(or_, [p.startswith(x) | (p == x.rstrip("/")) for x in REDIRECT_PATHS])
    return F.array_distinct(F.filter(paths, known))


def sitemap_hash(xml: Column) -> Column:
    """Hash of a sitemap's shape, without its addresses and dates."""
    bare = F.regexp_replace(F.regexp_replace(xml, "<loc>[^<]*</loc>", "<loc>URL</loc>"), "<lastmod>[^<]*</lastmod>", "<lastmod>DATE</lastmod>")
    return normal_hash(bare)


def _fields(text: Column, name: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?im)^[ \t]*{name}[ \t]*:[ \t]*([^\r\n]*[^\s])"), F.lit(1)), F.trim)


def security_txt(text: Column, as_of: str) -> Column:
    """struct<contacts, expires, expires_in_days, policy, signed>."""
    expires = F.get(_fields(text, "expires"), F.lit(0))
    return F.struct(_fields(text, "contact").alias("contacts"), expires.alias("expires"), days_until(expires, as_of).alias("expires_in_days"), F.get(_fields(text, "policy"), F.lit(0)).alias("policy"), text.contains("-----BEGIN PGP SIGNED MESSAGE-----").alias("signed"))


def humans_txt(text: Column) -> Column:
    """struct<lines, contact, team>."""
    lines = F.size(F.filter(F.split(text, "\r?\n"), lambda x: F.trim(x) != "")).cast("long")
    return F.struct(lines.alias("lines"), F.get(_fields(text, "contact"), F.lit(0)).alias("contact"), F.get(_fields(text, "(?:chef|developer|team)"), F.lit(0)).alias("team"))


def normal_domain(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(text), "(?i)^https?://", ""), "[/?#].*$", ""))
