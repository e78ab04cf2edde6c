"""Column expressions over HTML text. All stay in the JVM; absent values are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.registry import ANY_ELEMENT, CANONICAL, GENERIC_FONTS, HEAD, BODY, JSON_LD, LISTS, META, STRUCTURE, TITLE, java

def tagged(values: Column, tag: str, name: str = "kind", value: str = "value") -> Column:
    """Structs of a constant and each value."""
    return F.transform(values, lambda v: F.struct(F.lit(tag).alias(name), v.alias(value)))


def first(text: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(text, java(pattern), group)
    return F.when(found != "", found)


def every(text: Column, pattern: str, group: int = 1) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(java(pattern)), F.lit(group)), lambda x: x != "")


def short_hash(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 12)


def decode_entities(text: Column) -> Column:
    """Named references one after the other, the ampersand first, then numbers."""
    out = text
    for name, letter in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(letter))
    letter = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")

    def numbered(text: Column, pattern: str, base: int) -> Column:
        def put(acc: Column, ref: Column) -> Column:
            n = F.conv(F.regexp_extract(ref, "([0-9A-Fa-f]+);", 1), base, 10).cast("long")
            return F.when(n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF), F.replace(acc, ref, letter(n))).otherwise(acc)

        return F.when(text.contains("&#"), F.aggregate(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), text, put)).otherwise(text)

    return numbered(numbered(out, "&#([0-9]{1,7});", 10), "(?i)&#x([0-9a-f]{1,6});", 16)


def title(html: Column, decode=decode_entities) -> Column:
    """The title; decode: what reads its character references."""
    found = decode(F.trim(F.regexp_extract(html, TITLE, 1)))
    return F.when(found != "", found)


def tags(html: Column, name: str) -> Column:
    """The opening tags of a name, which patterns of attributes then search instead of the page."""
    return F.regexp_extract_all(html, F.lit(rf"(?i)<{name}[^>]+>?"), F.lit(0))


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def meta_of(found: Column, name: str) -> Column:
    """A named meta tag's content, from the page's meta tags: either order of the attributes, either quote; the first that isn't empty."""
    patterns = [p.replace("NAME", name) for p in META]
    text = F.array_join(F.filter(found, lambda t: F.lower(t).contains(name)), "\n")
    return let(text, lambda t: F.when(t != "", decode_entities(F.trim(F.coalesce(*[first(t, p) for p in patterns])))))


def meta(html: Column, name: str) -> Column:
    return meta_of(tags(html, "meta"), name)


def cards(html: Column, attribute: str, prefix: str) -> Column:
    """array<struct<key, value>> of og: or twitter: tags; of a repeated key the last one, as later patterns and hits win."""
    return cards_of(tags(html, "meta"), attribute, prefix)


def cards_of(found: Column, attribute: str, prefix: str) -> Column:
    """`cards`, from the page's meta tags."""

    def hits(text: Column) -> Column:
        out = []
        for quote in "\"'":
            name, value = f"{attribute}={quote}({prefix}:[^{quote}]+){quote}", f"content={quote}([^{quote}]*){quote}"
            for order, pattern in enumerate((f"(?i)<meta[^>]+{name}[^>]+{value}", f"(?i)<meta[^>]+{value}[^>]+{name}")):
                groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in ((1, 2), (2, 1))[order]]
                out.append((order, F.zip_with(*groups, lambda k, v: F.struct(k.alias("key"), v.alias("value")))))
        return F.filter(F.concat(*[h for _, h in sorted(out, key=lambda x: x[0])]), lambda x: (x["key"] != "") & (x["value"] != ""))

    def last(found: Column) -> Column:
        return F.filter(found, lambda x, i: ~F.exists(F.slice(found, i + 2, F.size(found)), lambda y: y["key"] == x["key"]))

    text = F.array_join(F.filter(found, lambda t: F.lower(t).contains(f"{prefix}:")), "\n")
    none = F.array().cast("array<struct<key:string,value:string>>")
    return let(text, lambda t: F.when(t != "", let(hits(t), last)).otherwise(none))


def canonical(html: Column) -> Column:
    return first(html, CANONICAL)


def stylesheets(html: Column) -> Column:
    links = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<link(?=[^A-Za-z0-9_])([^>]*)>"), F.lit(1)), lambda a: a.rlike(r"""(?i)rel=['"]stylesheet['"]"""))
    return F.filter(F.transform(links, lambda a: F.regexp_extract(a, r"""(?i)href=['"]([^'"]+)['"]""", 1)), lambda x: x != "")


def alternates(html: Column) -> Column:
    """array<struct<lang, href>> of links to the page in other languages."""
    links = F.filter(tags(html, "link"), lambda t: t.rlike(r"""(?i)\srel=['"]alternate['"]"""))
    part = lambda t, name: F.regexp_extract(t, rf"""(?i)\s{name}=['"]([^'"]+)['"]""", 1)
    return F.filter(F.transform(links, lambda t: F.struct(part(t, "hreflang").alias("lang"), part(t, "href").alias("href"))), lambda x: (x["lang"] != "") & (x["href"] != ""))


def head_hash(html: Column) -> Column:
    """Hash of the tags opened in the head; without a head, of nothing."""
    head = F.regexp_extract(html, java(HEAD), 1)
    return short_hash(F.array_join(F.regexp_extract_all(head, F.lit(ANY_ELEMENT), F.lit(0)), ","))


def _without(text: Column, tag: str) -> Column:
    """text without the elements of a tag. Without an end tag nothing is searched: that would take quadratic time."""
    return let(text, lambda t: F.when(t.rlike(f"(?i)</{tag}>"), F.regexp_replace(t, java(rf"(?i)<{tag}[\s\S]*?</{tag}>"), "")).otherwise(t))


def body_hash(html: Column) -> Column:
    """Hash of name:class:id of the body's structural elements."""
    # Few bodies hold what is to be removed; to look for it costs less than to replace it.
    bare = lambda b: F.when(b.contains("<!--"), F.regexp_replace(b, java(r"<!--[\s\S]*?-->"), "")).otherwise(b)
    plain = lambda b: F.when(b.rlike("(?i)</(?:script|style)>"), _without(_without(b, "script"), "style")).otherwise(b)
    body = let(let(F.regexp_extract(html, java(BODY), 1), bare), plain)
    tags = F.regexp_extract_all(body, F.lit(STRUCTURE), F.lit(0))
    part = lambda t: F.concat_ws(":", F.regexp_extract(t, "(?i)<([a-z]+)", 1), F.regexp_extract(t, r"""(?i)class=['"]([^'"]+)['"]""", 1), F.regexp_extract(t, r"""(?i)id=['"]([^'"]+)['"]""", 1))
    return short_hash(F.array_join(F.transform(tags, part), "|"))


def inline_hashes(html: Column, tag: str) -> Column:
    """Hashes of inline scripts (those without src) or styles of more than ten letters; repeats stay."""
    attrs = r"(?![^>]*src=)" if tag == "script" else ""
    bodies = F.transform(F.regexp_extract_all(html, F.lit(java(rf"(?i)<{tag}{attrs}[^>]*>([\s\S]*?)</{tag}>")), F.lit(1)), lambda x: F.trim(x, F.lit(" \t\r\n")))
    return F.transform(F.filter(bodies, lambda x: F.length(x) > 10), short_hash)


def comments(html: Column) -> Column:
    texts = F.transform(F.regexp_extract_all(html, F.lit(java(LISTS["comment"])), F.lit(1)), lambda x: F.trim(x, F.lit(" \t\r\n")))
    return F.filter(texts, lambda x: x.rlike("[A-Za-zÀ-ɏЀ-ӿ]{3,}"))


def emails(html: Column, most: int = 20, links: Column | None = None) -> Column:
    """Addresses in mailto links, then in the text; the first twenty distinct ones in lower case; links: whether there are such links, if that is known."""
    linked = F.transform(F.regexp_extract_all(html, F.lit(r"""(?i)mailto:([^"'?\s]+)"""), F.lit(1)), lambda x: F.lower(decode_entities(x)))
    none = F.array().cast("array<string>")
    linked = linked if links is None else F.when(links, linked).otherwise(none)
    domain = r"@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+"
    # Few pages hold a domain behind an @, and it is found far sooner than an address.
    found = lambda text: F.when(text.rlike(domain), F.regexp_extract_all(text, F.lit(rf"[A-Za-z0-9_.+-]+{domain}"), F.lit(0))).otherwise(none)
    bare = F.when(html.contains("@") & html.rlike(domain), let(F.regexp_replace(html, "<[^>]+>", " "), found)).otherwise(none)
    return F.slice(F.array_distinct(F.concat(linked, F.transform(bare, F.lower))), 1, most)


def visible_text(html: Column) -> Column:
    text = F.regexp_replace(_without(_without(html, "script"), "style"), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, "(?i)&[a-z]+;", " "), r"\s+", " "))


def image_count(html: Column) -> Column:
    return F.regexp_count(html, F.lit(r"(?i)<img(?=[^A-Za-z0-9_])")) + F.regexp_count(html, F.lit(r"(?i)<svg(?=[^A-Za-z0-9_])")) + F.regexp_count(html, F.lit(r"(?i)background(?:-image)?\s*:\s*url\("))


def font_families(html: Column) -> Column:
    """Families in font-family declarations without generic ones; commas inside brackets or quotes don't separate."""
    values = F.regexp_extract_all(html, F.lit(r"(?i)font-family\s*:\s*([^;}<]+)"), F.lit(1))
    names = F.flatten(F.transform(values, lambda v: F.regexp_extract_all(v, F.lit(r"""((?:[^,("']|\([^)]*\)|"[^"]*"|'[^']*')+)"""), F.lit(1))))
    names = F.transform(names, lambda n: F.trim(F.regexp_replace(F.regexp_replace(F.trim(n), "^['\"]+|['\"]+$", ""), r"\s+", " ")))
    real = lambda n: (n != "") & ~F.lower(n).isin(*GENERIC_FONTS) & ~F.lower(n).rlike(r"^(?:var\(|env\(|--)") & ~n.rlike("[:;{}]")
    return F.array_distinct(F.filter(names, real))


def robots(found: Column) -> Column:
    """What the page's meta tags tell robots; without a tag for all of them, what they tell Google's."""
    return F.coalesce(meta_of(found, "robots"), meta_of(found, "googlebot"))


def noindex(html: Column, header: Column | None = None) -> Column:
    own = F.coalesce(F.lower(robots(tags(html, "meta"))).contains("noindex"), F.lit(False))
    return own if header is None else own | F.coalesce(F.lower(header).contains("noindex"), F.lit(False))


def json_ld(html: Column) -> Column:
    """array<variant> of the items of ld+json blocks, those of @graph where there is one; malformed blocks are skipped."""
    raw = F.regexp_extract_all(html, F.lit(java(JSON_LD)), F.lit(1))
    return F.filter(F.transform(raw, lambda x: F.try_parse_json(F.trim(x))), lambda x: x.isNotNull())
