"""Deploy gates over all sites at once, their rollup over the fleet, and drift between two snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def failures(sites: DataFrame, routes: DataFrame, threshold: int = 60, need_security_txt: bool = False, expect_noindex: bool = False, need_email_auth: bool = False, min_seo: int | None = None) -> DataFrame:
    """(domain, route, name, value) of each failed gate. security.txt, e-mail authentication and a least SEO score of routes are asked
    for on demand only; `seo_failures` tells SEO scores with the checks that fail.

    sites: domain, cluster, status, is_adult, noindex, security, security_txt, spf_rating, dmarc_rating, errors; routes: domain,
    route, status, noindex, seo. A row's gates are branches of one expression, so sites are read once.
    """
    clean = F.col("cluster").isNotNull() & ~F.lower(F.trim("cluster")).startswith("adult")
    text = lambda c: F.col(c).cast("string")
    weak = lambda c: F.col(c).isNotNull() & (F.col(c) != "good")
    gates = [
        ("http", F.col("status") >= 400, text("status")), ("adult", clean & F.col("is_adult"), F.col("cluster")), ("noindex", F.col("noindex") & F.lit(not expect_noindex), F.lit(None).cast("string")),
        ("security", F.coalesce("security", F.lit(0)) < threshold, F.coalesce("security", F.lit(0)).cast("string")), ("security.txt", ~F.coalesce("security_txt", F.lit(False)) & F.lit(need_security_txt), F.lit(None).cast("string")),
        ("SPF", weak("spf_rating") & F.lit(need_email_auth), F.col("spf_rating")), ("DMARC", weak("dmarc_rating") & F.lit(need_email_auth), F.col("dmarc_rating")), ("errors", F.col("errors") > 0, text("errors")),
    ]
    row = lambda route, n, c, v: F.when(c, F.struct(route.alias("route"), F.lit(n).alias("name"), v.alias("value")))
    spread = lambda df, route, some: df.select("domain", F.explode(F.array_compact(F.array(*[row(route, *g) for g in some]))).alias("g")).select("domain", "g.*")
    ok = F.coalesce(F.col("status").between(200, 299), F.lit(False))
    on_routes = [("route", ~ok, text("status")), ("noindex", ok & F.col("noindex") & F.lit(not expect_noindex), F.lit(None).cast("string")), ("seo", ok & (F.col("seo") < F.lit(min_seo)), text("seo"))]
    return spread(sites, F.lit("/"), gates).unionByName(spread(routes, F.col("route"), on_routes))


def seo_failures(scores: DataFrame, checks: DataFrame, min_seo: int | None = None, required: tuple[str, ...] = (), no_hreflang: tuple[str, ...] = ()) -> DataFrame:
    """(domain, route, name, value) of SEO gates on the root and on routes: scores (domain, route, score) below the least one, with
    the checks that fail, and required checks (domain, route, check, rating) that fail. On routes that no_hreflang names (a
    trailing * stands for any end) a missing Hreflang is expected."""
    exempt = F.lit(False)
    for glob in no_hreflang:
        exempt = exempt | (F.col("route").startswith(glob[:-1]) if glob.endswith("*") else F.col("route") == glob)
    failing = checks.where((F.col("rating") != "good") & ~((F.col("check") == "Hreflang") & exempt))
    names = failing.groupBy("domain", "route").agg(F.array_join(F.sort_array(F.collect_set("check")), ", ").alias("why"))
    low = scores.where(F.col("score") < F.lit(min_seo)).join(names, ["domain", "route"], "left")
    low = low.select("domain", "route", F.lit("seo").alias("name"), F.concat_ws(": ", F.col("score").cast("string"), "why").alias("value"))
    asked = failing.where(F.lower("check").isin(*[r.strip().lower() for r in required])) if required else failing.limit(0)
    return low.unionByName(asked.select("domain", "route", F.concat(F.lit("seo check: "), F.col("check")).alias("name"), F.col("rating").alias("value")))


def rollup(failed: DataFrame, sites: DataFrame) -> DataFrame:
    """(route, name, k, n): on how many of the fleet's n sites a gate fails."""
    total = sites.agg(F.count(F.lit(1)).alias("n"))
    return failed.groupBy("route", "name").agg(F.count_distinct("domain").alias("k")).crossJoin(total)  # total is one row


def exit_codes(sites: DataFrame, failed: DataFrame) -> DataFrame:
    """(domain, code): 1 where any gate fails."""
    bad = failed.select("domain").distinct().withColumn("code", F.lit(1))
    return sites.select("domain").join(bad, "domain", "left").select("domain", F.coalesce("code", F.lit(0)).alias("code"))


def fleet_code(findings: DataFrame, score: DataFrame, warning: int = 40) -> DataFrame:
    """One row (code): 2 with a critical finding (severity), else 1 if the isolation score (one row) is below a threshold, else 0."""
    critical = findings.agg(F.count(F.when(F.col("severity") == "critical", 1)).alias("critical"))
    low = score.agg(F.min("score").alias("score"))
    both = critical.crossJoin(low)  # one row each
    return both.select(F.when(F.col("critical") > 0, 2).when(F.col("score") < warning, 1).otherwise(0).alias("code"))


def drift(before: DataFrame, after: DataFrame, ids_before: DataFrame, ids_after: DataFrame) -> DataFrame:
    """(domain, change, detail) between two snapshots (domain, noindex, adult, security, seo, spf, dmarc) and their ids (domain, kind, id)."""
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    moved = lambda c: x(c).isNotNull() & y(c).isNotNull() & (x(c) != y(c))
    arrow = lambda c: F.concat_ws(" -> ", x(c).cast("string"), y(c).cast("string"))
    here = x("here").isNotNull() & y("here").isNotNull()
    changes = [
        ("new-domain", x("here").isNull(), F.lit("")), ("removed-domain", y("here").isNull(), F.lit("")), ("noindex", here & moved("noindex"), arrow("noindex")),
        ("adult-score", here & (F.abs(x("adult") - y("adult")) >= 10), arrow("adult")), ("security-score", here & moved("security"), arrow("security")), ("seo-score", here & moved("seo"), arrow("seo")),
        ("spf", here & ~x("spf").eqNullSafe(y("spf")), arrow("spf")), ("dmarc", here & ~x("dmarc").eqNullSafe(y("dmarc")), arrow("dmarc")),
    ]
    both = before.withColumn("here", F.lit(1)).alias("x").join(after.withColumn("here", F.lit(1)).alias("y"), "domain", "full_outer")
    rows = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("change"), d.alias("detail"))) for n, c, d in changes]))
    out = both.select("domain", F.explode(rows).alias("c")).select("domain", "c.*")
    known = before.select("domain").join(after.select("domain"), "domain")
    keys = ["domain", "kind", "id"]
    gone = ids_before.distinct().join(ids_after, keys, "left_anti").withColumn("change", F.lit("id-removed"))
    new = ids_after.distinct().join(ids_before, keys, "left_anti").withColumn("change", F.lit("id-added"))
    ids = gone.unionByName(new).join(known, "domain", "left_semi").select("domain", "change", F.concat_ws(":", "kind", "id").alias("detail"))
    return reduce(DataFrame.unionByName, [out, ids])


def finding_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, type, domains, detail) of findings (type, domains array, detail) in one snapshot only; the order of sites doesn't count."""
    keys = ["type", "domains", "detail"]
    norm = lambda df: df.select("type", F.array_join(F.array_sort("domains"), ",").alias("domains"), "detail").distinct()
    x, y = norm(before), norm(after)
    return x.join(y, keys, "left_anti").withColumn("change", F.lit("resolved")).unionByName(y.join(x, keys, "left_anti").withColumn("change", F.lit("new"))).select("change", *keys)


def check_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(domain, route, change, check) of checks (domain, route, check, rating) that fail now or are fixed, on pages in both snapshots."""
    keys = ["domain", "route"]
    known = before.select(*keys).distinct().join(after.select(*keys).distinct(), keys)
    bad = lambda df: df.where("rating <> 'good'").select(*keys, "check").distinct().join(known, keys)
    x, y = bad(before), bad(after)
    now = y.join(x, [*keys, "check"], "left_anti").withColumn("change", F.lit("now-failing"))
    return now.unionByName(x.join(y, [*keys, "check"], "left_anti").withColumn("change", F.lit("fixed"))).select(*keys, "change", "check")


def page_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(domain, route, change, detail) of page audits (domain, route, ok, noindex, canonical, seo) in both snapshots; a page that went
    down or came up has that change alone."""
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("(none)"))
    arrow = lambda c: F.concat_ws(" -> ", text(x(c)), text(y(c)))
    same = x("ok") == y("ok")
    changes = [
        ("reachable", ~same, arrow("ok")), ("noindex", same & (x("noindex") != y("noindex")), arrow("noindex")), ("canonical", same & ~x("canonical").eqNullSafe(y("canonical")), arrow("canonical")),
        ("seo-score", same & (x("seo") != y("seo")), arrow("seo")),
    ]
    rows = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("change"), d.alias("detail"))) for n, c, d in changes]))
    both = before.alias("x").join(after.alias("y"), ["domain", "route"])
    return both.select("domain", "route", F.explode(rows).alias("c")).select("domain", "route", "c.*")


def email_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(domain, check, detail, severity) of mail checks (domain, check, rating, value) whose rating or value changed; null severity for
    the better."""
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    both = before.alias("x").join(after.alias("y"), ["domain", "check"]).where((x("rating") != y("rating")) | ~x("value").eqNullSafe(y("value")))
    severity = F.when(y("rating").isin("bad", "missing"), "high").when(y("rating") != "good", "medium")
    return both.select("domain", "check", F.concat_ws(" -> ", x("rating"), y("rating")).alias("detail"), severity.alias("severity"))
