"""Scan records of pages: the scanners that are asked for as columns of one projection over one read.

A record has the shape of a stored scan (`sources.tables.SNAPSHOT`), so the rules on scan records apply to it. Scanners that are
not asked for are null and cost nothing: Spark prunes what no column needs, down to the page's text. Derived scanners run those that
they are made of. A scanner that a page table holds no evidence for gives an error of the record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import markup
from tessera.operators import identifiers
from tessera.registry import ACCOUNT_KINDS, DERIVED_SCANNERS, FORM_ENDPOINTS, SCANNERS


def unknown(names: list[str]) -> list[str]:
    """Names that no scanner has."""
    return [n for n in names if n not in SCANNERS and n not in DERIVED_SCANNERS]


def expanded(names: list[str]) -> list[str]:
    """names, each followed by the scanners that it is derived from, once each."""
    return list(dict.fromkeys(x for n in names for x in (n, *DERIVED_SCANNERS.get(n, ()))))


def _html(html: Column) -> Column:
    cards = F.map_from_entries(markup.cards(html, "name", "twitter"))
    items = F.flatten(F.transform(markup.json_ld(html), lambda v: F.coalesce(F.try_variant_get(v, "$['@graph']", "array<variant>"), F.array(v))))
    same = lambda v: F.coalesce(F.try_variant_get(v, "$.sameAs", "array<string>"), F.array_compact(F.array(F.try_variant_get(v, "$.sameAs", "string"))))
    return F.struct(
        markup.head_hash(html).alias("headStructureHash"), markup.body_hash(html).alias("bodyStructureHash"), markup.meta(html, "generator").alias("metaGenerator"),
        markup.inline_hashes(html, "script").alias("inlineScriptHashes"), markup.comments(html).alias("comments"), markup.emails(html).alias("emails"),
        F.array_distinct(F.concat(*[markup.every(html, p) for p in FORM_ENDPOINTS])).alias("formEndpoints"), cards.alias("twitterCards"), F.transform(items, lambda v: F.struct(same(v).alias("sameAs"))).alias("jsonLd"),
    )


def _analytics(html: Column) -> Column:
    def split(hits: Column) -> Column:
        ids = lambda name: F.transform(F.filter(hits, lambda h: h["name"] == name), lambda h: h["id"])
        lists = {kind: ids(name) for name, kind in ACCOUNT_KINDS.items() if kind != "umami_id"} | {"plausible": ids("Plausible Domain")}
        other = F.filter(hits, lambda h: ~h["name"].isin(*ACCOUNT_KINDS, "Plausible Domain"))
        return F.struct(*[v.alias(k) for k, v in lists.items()], other.alias("other"))

    return markup.let(identifiers.account_hits(html), split)


def _assets(html: Column) -> Column:
    return F.struct(markup.every(html, markup.LISTS["font_source"]).alias("fontSources"))


#: Scanners that a page's text is evidence enough for.
ON_PAGES = {"html": _html, "analytics": _analytics, "assets": _assets}


def scan(pages: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(page_id, domain, a column for each scanner, errors) of pages (page_id, host, html); only: the scanners to run, else all."""
    if only is not None and (odd := unknown(only)):
        raise ValueError(f"unknown scanners: {', '.join(odd)}")
    run = [n for n in (expanded(only) if only is not None else SCANNERS) if n in SCANNERS]
    text = F.col("text_")  # a column beside one of the same name would be taken for it
    columns = [f(text).alias(n) if n in run else F.lit(None).alias(n) for n, f in ON_PAGES.items()]
    errors = [F.struct(F.lit(n).alias("scanner"), F.lit("no evidence in a page table").alias("error")) for n in run if n not in ON_PAGES]
    none = F.array().cast("array<struct<scanner:string,error:string>>")
    return pages.select("page_id", "host", F.col("html").alias("text_")).select("page_id", F.col("host").alias("domain"), *columns, (F.array(*errors) if errors else none).alias("errors"))
