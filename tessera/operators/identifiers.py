"""Account identifiers as a fact table: (page_id, name, id), from literal patterns in one pass over the pages."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import markup, matcher
from tessera.registry import ACCOUNT_IDS, DNS_TOKENS, FORM_ENDPOINTS, PREFIX, java, literal


def _prefixed(values: Column, name: str) -> Column:
    return F.transform(values, lambda x: F.struct(F.lit(name).alias("name"), F.concat(F.lit(PREFIX.get(name, "")), x).alias("id")))


_RULES = [(name, p) for name, p in ACCOUNT_IDS if name != "Umami Script Source"]
#: Leads of the patterns, which one search finds in a page.
LEADS = {matcher.rare_lead(p) for _, p in _RULES} - {""}


def account_hits(html: Column, found: Column | None = None) -> Column:
    """array<struct<name, id>>, distinct. A pattern is searched for only where the letters that each of its matches holds are there.

    found: the leads that the page holds, those of LEADS at least.
    """
    if found is None:
        return markup.let(matcher.pairs_in(html, LEADS), lambda x: account_hits(html, x))
    none, hits = F.array().cast("array<string>"), []
    for name, p in _RULES:
        lead, mark = matcher.rare_lead(p), literal(p)
        tests = [matcher.holds(found, lead)] if lead else []
        tests += [html.contains(mark)] if mark and not p.startswith("(?i)") else []
        values = markup.every(html, p)
        hits.append(_prefixed(F.when(reduce(and_, tests), values).otherwise(none) if tests else values, name))
    return F.array_distinct(F.concat(*hits))


def account_ids(pages: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Distinct (keys, name, id); keys: columns of pages to keep."""
    return pages.select(*keys, F.explode(account_hits(F.col("html"))).alias("h")).select(*keys, "h.name", "h.id").distinct()


def dns_tokens(records: DataFrame) -> DataFrame:
    """(domain, name, id) from TXT records (domain, value): the first match of each vendor's pattern, repeats stay."""
    hits = [F.struct(F.lit(f"DNS:{name}").alias("name"), markup.first(F.col("value"), p).alias("id")) for name, p in DNS_TOKENS]
    return records.select("domain", F.explode(F.filter(F.array(*hits), lambda h: h["id"].isNotNull())).alias("h")).select("domain", "h.name", "h.id")


#: A script source or a website id of an Umami install.
_SOURCE, _SITE = (next(java(p) for n, p in ACCOUNT_IDS if n == name) for name in ("Umami Script Source", "Umami Website ID"))
_EITHER = "=(?:" + "|".join(f"(?<={name}=){value}" for name, _, value in (p.partition("=") for p in (_SOURCE, _SITE))) + ")"


def _has_installs(html: Column) -> Column:
    return html.contains("umami") & html.contains("data-website-id=")


def umami_tokens(html: Column) -> Column:
    """array<struct<m, g>>: each source or id from its equals sign on, in order, and the length of what stands before it, if that matters; empty for a page
    without ids, which has no pairs, whatever its sources. Equals signs are rare, first letters of attributes are not."""

    def placed(found: Column) -> Column:
        ids = F.filter(found, lambda m: ~m.contains("umami"))
        # One id is the nearest one, wherever it stands.
        gaps = F.when(F.size(ids) > 1, F.transform(F.split(html, _EITHER, -1), F.length)).otherwise(F.transform(found, lambda _: F.lit(0)))
        return F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))

    tokens = markup.let(F.regexp_extract_all(html, F.lit(_EITHER), F.lit(0)), placed)
    return F.when(_has_installs(html), tokens).otherwise(F.array().cast("array<struct<m:string,g:int>>"))


def umami_pairs(pages: DataFrame) -> DataFrame:
    """(page_id, website_id, src) of pages (page_id, html)."""
    return pairs_of(pages.where(_has_installs(F.col("html"))).select("page_id", umami_tokens(F.col("html")).alias("tokens")))


def pairs_of(pages: DataFrame) -> DataFrame:
    """(page_id, website_id, src) of pages (page_id, tokens): each script source, in order, goes to the nearest website id, if that has none yet.

    Sources and ids are one list of rows by place, which two windows go through, forwards and backwards: the nearest id of a source
    is the last one before it or the first one behind it, the former if both are as far. Places are sums of the lengths of matches
    and of what stands between them, as patterns give no offsets. page_id names a page.
    """
    tokens = pages.select("page_id", F.posexplode("tokens").alias("n", "t"))
    so_far = Window.unboundedPreceding, Window.currentRow
    before, behind = (Window.partitionBy("page_id").orderBy(order).rowsBetween(*so_far) for order in (F.asc("n"), F.desc("n")))
    size, source = F.length("t.m"), F.col("t.m").contains("umami")
    name = F.when(source, F.lit(len("src"))).otherwise(F.lit(len("data-website-id")))  # letters before the equals sign
    placed = tokens.select("page_id", "n", source.alias("source"), F.regexp_extract("t.m", "=['\"]([^'\"]*)", 1).alias("value"), (F.sum(F.col("t.g") + size).over(before) - size - name).alias("at"))
    own = F.when(~F.col("source"), F.struct("at", "value"))
    near = placed.select("page_id", "n", "source", "value", "at", F.last(own, True).over(before).alias("last"), F.last(own, True).over(behind).alias("next")).where("source")
    backwards = F.col("next").isNull() | (F.col("at") - F.col("last.at") <= F.col("next.at") - F.col("at"))
    named = near.select("page_id", "n", F.col("value").alias("src"), F.when(F.col("last").isNotNull() & backwards, F.col("last.value")).otherwise(F.col("next.value")).alias("website_id")).where("website_id IS NOT NULL")
    return named.groupBy("page_id", "website_id").agg(F.min_by("src", "n").alias("src"))


def facts(pages: DataFrame) -> DataFrame:
    """(page_id, kind, value) of what pages share with others; repeats stay."""
    html = F.col("html")
    lists = {
        "script_src": markup.every(html, markup.LISTS["script_src"]), "stylesheet": markup.stylesheets(html), "comment": markup.comments(html), "email": markup.emails(html),
        "og_image": F.concat(markup.every(html, markup.LISTS["og_image"]), markup.every(html, markup.LISTS["og_image_after"])), "hreflang": markup.every(html, markup.LISTS["hreflang"]), "font": markup.font_families(html),
        "font_source": markup.every(html, markup.LISTS["font_source"]), "inline_script": markup.inline_hashes(html, "script"), "inline_style": markup.inline_hashes(html, "style"),
    }
    named = [markup.tagged(values, kind) for kind, values in lists.items()]
    return pages.select("page_id", F.explode(F.concat(*named)).alias("f")).select("page_id", "f.kind", "f.value")


def form_endpoints(pages: DataFrame) -> DataFrame:
    found = reduce(lambda a, b: F.concat(a, b), [markup.every(F.col("html"), p) for p in FORM_ENDPOINTS])
    return pages.select("page_id", F.explode(F.array_distinct(found)).alias("endpoint"))


def json_ld(pages: DataFrame) -> DataFrame:
    """(page_id, type, name, url, same_as) of each item; same_as is joined by |."""
    blocks = pages.where(F.col("html").contains("ld+json")).select("page_id", F.explode(markup.json_ld(F.col("html"))).alias("v"))
    items = F.coalesce(F.try_variant_get("v", "$['@graph']", "array<variant>"), F.array("v"))
    one = blocks.select("page_id", F.explode(items).alias("v"))
    text = lambda key: F.try_variant_get("v", f"$['{key}']", "string")
    same = F.coalesce(F.try_variant_get("v", "$.sameAs", "array<string>"), F.array_compact(F.array(F.try_variant_get("v", "$.sameAs", "string"))))
    return one.select("page_id", text("@type").alias("type"), text("name").alias("name"), text("url").alias("url"), F.array_join(same, "|").alias("same_as"))
