"""Content hashes of a page's favicon, stylesheets and scripts: its references resolved, then joined with fetched bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import markup, records


def references(pages: DataFrame) -> DataFrame:
    """Distinct (page_id, kind, url) of favicon, css and js; without a link to an icon, the favicon is /favicon.ico."""
    html = F.col("html")
    icons = F.filter(markup.tags(html, "link"), lambda t: t.rlike(r"""(?i)rel=['"](?:shortcut\s+)?icon['"]"""))
    icon = F.coalesce(F.nullif(F.regexp_extract(F.get(icons, F.lit(0)), r"""(?i)href=['"]([^'"]+)['"]""", 1), F.lit("")), F.lit("/favicon.ico"))
    lists = {"favicon": F.array(icon), "css": markup.every(html, r"""(?i)<link[^>]+href=['"]([^'"]+\.css[^'"]*)['"]"""), "js": markup.every(html, r"""(?i)<script[^>]+src=['"]([^'"]+\.js[^'"]*)['"]""")}
    each = F.concat(*[markup.tagged(v, k, value="ref") for k, v in lists.items()])
    rows = pages.select("page_id", "url", F.explode(each).alias("r")).select("page_id", "r.kind", records.resolve_url(F.col("url"), F.col("r.ref")).alias("url"))
    return rows.where("url IS NOT NULL").distinct()


def hashes(pages: DataFrame, bodies: DataFrame) -> DataFrame:
    """(page_id, kind, url, hash) from bodies (url, body): of the content, or, where it wasn't fetched, of the address; a favicon that
    wasn't fetched has none."""
    both = references(pages).join(bodies, "url", "left")
    text = F.when(F.col("body").isNotNull(), F.when(F.col("kind") == "favicon", F.base64(F.col("body").cast("binary"))).otherwise(F.col("body"))).when(F.col("kind") != "favicon", F.col("url"))
    return both.where(text.isNotNull()).select("page_id", "kind", "url", markup.short_hash(text).alias("hash"))
