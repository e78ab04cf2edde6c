"""Pages of a site beside its front page: from sitemaps, as audits of routes, and merged into what the site holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import markup
from tessera.operators import scoring
from tessera.registry import VENDOR_NAMES, VENDORS

#: Endings of what is no page.
_FILES = r"(?i)\.(?:xml|xml\.gz|gz|txt|pdf|jpe?g|png|svg|gif|webp|ico|css|js|json|rss|atom)$"


def sitemap_entries(files: DataFrame) -> DataFrame:
    """(domain, sitemap, loc, is_index, is_page) of sitemap files (domain, sitemap, xml): an entry of an index is a sitemap; one of a
    list is a page, if it is neither the front page nor a file of another kind."""
    locs = F.regexp_extract_all("xml", F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    rows = files.select("domain", "sitemap", F.col("xml").rlike(r"(?i)<sitemapindex[\s>]").alias("is_index"), F.explode(locs).alias("loc"))
    front = F.col("loc").endswith(F.col("domain")) | F.col("loc").endswith(F.concat("domain", F.lit("/")))
    return rows.select("domain", "sitemap", "loc", "is_index", (~F.col("is_index") & ~front & ~F.col("loc").rlike(_FILES)).alias("is_page"))


def sitemap_pages(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct (domain, url): pages in the root sitemaps (domain, sitemap), and, where a root is an index, in its children."""
    entries = sitemap_entries(files)
    own = entries.join(roots, ["domain", "sitemap"])
    children = own.where("is_index").select("domain", F.col("loc").alias("sitemap")).distinct()
    pages = own.where("is_page").unionByName(entries.join(children, ["domain", "sitemap"]).where("is_page"))
    return pages.select("domain", F.col("loc").alias("url")).distinct()


def merged_ids(front: DataFrame, subpages: DataFrame) -> DataFrame:
    """Distinct (domain, name, id) of a site's front page and its other pages; tokens of DNS records count once, with the front page."""
    return front.select("domain", "name", "id").unionByName(subpages.where("NOT name LIKE 'DNS:%'").select("domain", "name", "id")).distinct()


def vendors(scans: DataFrame) -> DataFrame:
    """(domain, vendors): names of the analytics vendors on a site in a fixed order, then others by name; joined by commas."""
    has = lambda c: F.coalesce(F.size(F.col(f"analytics.{c}")), F.lit(0)) > 0
    fixed = F.array_compact(F.array(*[F.when(has(c), F.lit(name)) for c, name in VENDORS]))
    others = F.filter(F.coalesce("analytics.other", F.array().cast("array<struct<name:string,id:string>>")), lambda o: o["name"].isin(*VENDOR_NAMES))
    names = F.concat(fixed, F.array_sort(F.array_distinct(F.transform(others, lambda o: o["name"]))))
    return scans.where("analytics IS NOT NULL").select("domain", F.array_join(names, ", ").alias("vendors"))


def route_audits(pages: DataFrame) -> DataFrame:
    """(domain, route, ok, noindex, canonical, seo) of fetched routes (page_id, domain, route, url, html, status); what didn't answer with
    a status from 200 to 299 has no content."""
    ok = F.coalesce(F.col("status").between(200, 299), F.lit(False))
    seo = scoring.seo_score(pages.where(ok).select("page_id", "url", "html")).withColumnRenamed("score", "seo")
    html = F.col("html")
    rows = pages.select("page_id", "domain", "route", ok.alias("ok"), F.when(ok, markup.noindex(html)).alias("noindex"), F.when(ok, markup.canonical(html)).alias("canonical"))
    return rows.join(seo, "page_id", "left").drop("page_id")


def report_lines(findings: DataFrame, score: DataFrame, unreachable: DataFrame) -> DataFrame:
    """(part, line) of a fleet report: the score, sites that weren't reached, counts by severity, and a line for each finding (type, severity,
    domains, detail), worst first; to be ordered by part and line."""
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    top = score.select(F.lit("0 score").alias("part"), F.concat(F.lit("Isolation score: "), F.col("score").cast("string"), F.lit("/100")).alias("line"))
    down = unreachable.select(F.lit("1 unreachable").alias("part"), F.concat_ws(": ", "domain", "reason").alias("line"))
    counts = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("2 count "), rank.cast("string")).alias("part"), F.concat(F.upper("severity"), F.lit(": "), F.col("n").cast("string")).alias("line"))
    each = findings.select(F.concat(F.lit("3 finding "), rank.cast("string")).alias("part"), F.concat(F.lit("["), F.col("type"), F.lit("] "), F.col("detail"), F.lit(" ("), F.col("domains"), F.lit(")")).alias("line"))
    return top.unionByName(down).unionByName(counts).unionByName(each)
