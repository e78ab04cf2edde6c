"""What the hosts of a page table share: (domain, kind, key, times), for the rules on pairs and on keys of many sites.

A page's signals are one array, exploded and counted by host; account ids, of which there are many patterns, and Umami installs, whose
parts are matched by their places, are rows of their own. Kinds that a site has one of (structure hashes, generator,
twitter:site) come from its lowest page; all others from all of its pages, with the number of times that they occur there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import markup, matcher
from tessera.operators import identifiers
from tessera.registry import ACCOUNT_KINDS, CRITICAL_ACCOUNTS, FORM_ENDPOINTS, FORM_MARK, IGNORED_ACCOUNTS
from tessera.sources import tables

#: Kinds of which a site has the one of its lowest page.
SINGLE = ("head", "body", "generator", "twitter_site")


def _tagged(values: Column, kind: str) -> Column:
    return markup.tagged(values, kind, value="key")


def _one(value: Column) -> Column:
    """The value in an array, unless it is null or empty; it is computed once."""
    return F.filter(F.array(value), lambda x: x != "")


def account_kind(name: Column, id_: Column) -> tuple[Column, Column]:
    """Kind and key of an account id: of a rule of its own, or of all others by how telling they are; null if it is no signal."""
    script = id_.rlike(r"\.js(?:\?|$)") | id_.contains("/")
    kind = F.when(name == "Plausible Domain", F.when(~script, "plausible_domain").when(~id_.contains("plausible.io/"), "plausible_src"))
    for own, rule in ACCOUNT_KINDS.items():
        kind = kind.when(name == own, rule)
    other = ~name.isin(*ACCOUNT_KINDS, "Plausible Domain", *IGNORED_ACCOUNTS)
    kind = kind.when(other, F.when(name.isin(*CRITICAL_ACCOUNTS), "account_critical").otherwise("account_high"))
    return kind, F.when(other, F.concat_ws("\t", name, id_)).otherwise(id_)


#: Leads of fonts, mail links and ld+json, whose patterns are tried only where these are.
_FONT, _LINK, _JSON = map(matcher.rare_lead, (r"url\(", "mailto:", r"ld\+json"))
LEADS = identifiers.LEADS | {_FONT, _LINK, _JSON}


def page_signals(html: Column, found: Column | None = None) -> Column:
    """array<struct<kind, key>> of a page without its account ids, repeats included; found: those of LEADS that it holds."""
    if found is None:
        return markup.let(matcher.pairs_in(html, LEADS), lambda x: page_signals(html, x))
    blocks = F.when(matcher.holds(found, _JSON), markup.json_ld(html)).otherwise(F.array().cast("array<variant>"))
    items = F.flatten(F.transform(blocks, lambda v: F.coalesce(F.try_variant_get(v, "$['@graph']", "array<variant>"), F.array(v))))
    same = F.flatten(F.transform(items, lambda v: F.coalesce(F.try_variant_get(v, "$.sameAs", "array<string>"), F.array_compact(F.array(F.try_variant_get(v, "$.sameAs", "string"))))))
    forms = F.when(html.rlike(FORM_MARK), F.array_distinct(F.concat(*[markup.every(html, p) for p in FORM_ENDPOINTS])))
    urls = F.when(matcher.holds(found, _FONT), markup.every(html, markup.LISTS["font_source"])).otherwise(F.array().cast("array<string>"))
    fonts = F.transform(urls, lambda u: F.substring_index(F.substring_index(u, "/", -1), "?", 1))
    twitter = lambda tags: F.filter(markup.cards_of(tags, "name", "twitter"), lambda x: x["key"] == "twitter:site")
    metas = lambda tags: F.concat(_tagged(_one(markup.meta_of(tags, "generator")), "generator"), _tagged(F.transform(twitter(tags), lambda x: x["value"]), "twitter_site"))
    kinds = {
        "head": _one(markup.head_hash(html)), "body": _one(markup.body_hash(html)),
        "inline_script": markup.inline_hashes(html, "script"), "css": markup.inline_hashes(html, "style"), "comment": markup.comments(html), "email": markup.emails(html, links=matcher.holds(found, _LINK)), "font": fonts, "form_endpoint": F.coalesce(forms, F.array().cast("array<string>")),
        "sameas": F.array_distinct(F.filter(same, lambda x: x.isNotNull())),
    }
    return F.concat(markup.let(markup.tags(html, "meta"), metas), *[_tagged(values, kind) for kind, values in kinds.items()])


def page_facts(pages: DataFrame) -> DataFrame:
    """(page_id, domain, signals, accounts, tokens): all that is read from a page, as arrays; a page is gone through once."""
    html = F.col("html")
    each = lambda found: F.struct(page_signals(html, found).alias("signals"), identifiers.account_hits(html, found).alias("accounts"))
    one = pages.select("page_id", F.col("host").alias("domain"), markup.let(matcher.pairs_in(html, LEADS), each).alias("x"), identifiers.umami_tokens(html).alias("tokens"))
    return one.select("page_id", "domain", "x.signals", "x.accounts", "tokens")


def signals(pages: DataFrame) -> DataFrame:
    """(domain, kind, key, times) of the hosts of pages (page_id, host, html); times: how often the host's pages hold the key."""
    facts = tables.stored(page_facts(pages), "page-facts")
    each = facts.select("domain", "page_id", F.explode("signals").alias("s")).select("domain", "page_id", "s.*")
    kind, key = account_kind(F.col("name"), F.col("id"))
    named = facts.select("domain", "page_id", F.explode("accounts").alias("h")).select("domain", "page_id", "h.*").distinct()
    accounts = named.select("domain", "page_id", kind.alias("kind"), key.alias("key")).where("kind IS NOT NULL")
    each = each.unionByName(accounts)
    single = F.col("kind").isin(*SINGLE)
    counted = each.groupBy("domain", "kind", F.when(~single, F.col("key")).alias("many")).agg(F.min_by("key", "page_id").alias("one"), F.count(F.lit(1)).alias("n"))
    found = counted.select("domain", "kind", F.coalesce("many", "one").alias("key"), F.when(single, F.lit(1)).otherwise(F.col("n")).cast("long").alias("times"))
    installs = identifiers.pairs_of(facts).join(facts.select("page_id", "domain"), "page_id").where("src <> ''")
    # An install is a website id; a site has it once.
    once = installs.groupBy("domain", "website_id").agg(F.min_by("src", "page_id").alias("key"))
    return found.unionByName(once.groupBy("domain", F.lit("umami_src").alias("kind"), "key").agg(F.count(F.lit(1)).alias("times")))


def sites(pages: DataFrame) -> DataFrame:
    """(domain, ord, cluster): a host's lowest page gives its place; hosts under one registered name are a cluster."""
    return pages.groupBy(F.col("host").alias("domain")).agg(F.min("page_id").alias("ord")).withColumn("cluster", F.regexp_extract("domain", r"([^.]+\.[^.]+)$", 1))
