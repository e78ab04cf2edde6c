"""Correlation without pairs: what sites share, as classes, and the counts that scores need.

A key that n sites hold links n (n - 1) / 2 pairs; a report of a fleet of thousands is read by key, and its scores need numbers of
pairs only. So a class is one row (kind, key) with the number of its members and of the links within and across clusters, and its
members are rows (kind, key, domain), read when they are asked for; `representatives` links each member with the first. Numbers of
links are sums of squares. A rule that counts a pair once over several keys needs the number of pairs that share at least one of
them: by inclusion and exclusion over the sets of keys that sites hold, which is linear in sites. Keys that the same sites hold are one
there, keys of one site none; sites with more than MOST keys left, whose subsets would be too many, are counted by pairs of
classes of equal sites instead, which gives the same.

Kinds of which the first shared key decides (`correlate.FIRST`) can't be told by keys alone: findings of them are counted by pairs,
and similarity here is without them; pages don't have them.

signals: (domain, kind, key, times); sites: (domain, ord, cluster), ord unique, cluster null for unclustered sites. Null keys
share nothing. Rules are those of `correlate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import correlate
from tessera.registry import COMMODITY, FLEET_WIDE, PAIR_RULES, PENALTY, SUPPRESSIBLE, TOKEN_RULES

#: Keys of a site whose subsets are counted.
MOST = 8
#: Kinds of which each pair of installs counts.
INSTALLS = correlate.INSTALLS


def members(signals: DataFrame, sites: DataFrame) -> DataFrame:
    """(kind, key, domain, ord, cluster, times): one row for each site and key."""
    own = signals.where(F.col("key").isNotNull() & ~F.col("kind").isin(*correlate.FIRST) & ~((F.col("kind") == "cloudflare") & (F.length("key") < 20)))
    return own.groupBy("domain", "kind", "key").agg(F.sum("times").alias("times")).join(sites, "domain").select("kind", "key", "domain", "ord", "cluster", "times")


def fleet_wide(signals: DataFrame) -> DataFrame:
    """(key): ids that occur three times or more in the fleet, whichever kind they are of; their pair findings give way."""
    ids = signals.where(F.col("kind").isin(*SUPPRESSIBLE, "umami_id") & F.col("key").isNotNull())
    return ids.groupBy("key").agg(F.sum("times").alias("n")).where("n >= 3").select("key")


def _pairs(n: Column) -> Column:
    return F.floor(n * (n - 1) / 2).cast("long")


def _weight() -> Column:
    """What a member counts: once, or each of its installs."""
    return F.when(F.col("kind").isin(*INSTALLS), F.col("times")).otherwise(F.lit(1).cast("long"))


def links(held: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n (members), first (domain), same, cross: numbers of links within and across clusters among rows with the same keys.

    held: keys, domain, ord, cluster, w. Summed up by cluster first, so that no task sees all members of a key.
    """
    parts = held.groupBy(*keys, "cluster").agg(
        F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("w2"), F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "domain")).alias("first")
    )
    within = F.when(F.col("cluster").isNotNull(), F.col("w") * F.col("w") - F.col("w2"))
    sums = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("w").alias("w"), F.sum("w2").alias("w2"), F.coalesce(F.sum(within), F.lit(0)).alias("within"))
    half = lambda x: F.expr(f"({x}) div 2")
    return sums.select(*keys, "n", F.col("first.domain").alias("first"), half("within").alias("same"), half("w * w - w2 - within").alias("cross"))


def key_classes(signals: DataFrame, sites: DataFrame) -> DataFrame:
    """(kind, key, type, n, first, links_same, links_cross, wide): keys that two sites or more hold, of kinds with a rule on pairs."""
    rules = F.broadcast(correlate._pair_rules(signals).select("kind", "type"))  # of fixed size
    held = members(signals, sites).withColumn("w", _weight())
    found = links(held, ["kind", "key"]).where("n > 1").join(rules, "kind")
    wide = fleet_wide(signals).withColumn("wide", F.lit(True))
    out = found.join(wide, "key", "left")
    return out.select("kind", "key", "type", "n", "first", F.col("same").alias("links_same"), F.col("cross").alias("links_cross"), (F.coalesce("wide", F.lit(False)) & F.col("kind").isin(*SUPPRESSIBLE)).alias("wide"))


def representatives(signals: DataFrame, sites: DataFrame) -> DataFrame:
    """(kind, key, first, domain): each member of a class but the first, with the first: a tree that spans the class."""
    classes = key_classes(signals, sites).select("kind", "key", "first")
    return members(signals, sites).join(classes, ["kind", "key"]).where("domain <> first").select("kind", "key", "first", "domain")


def _key_sets(held: DataFrame) -> DataFrame:
    """(kind, domain, cluster, keys): numbers of the keys of each kind that a site shares with others, keys of the same sites as one."""
    mark = lambda *x: F.xxhash64(*x)
    digest = F.struct(F.count(F.lit(1)).alias("n"), F.sum(mark("domain").cast("decimal(38,0)")).alias("a"), F.sum(mark(F.lit("b"), "domain").cast("decimal(38,0)")).alias("b"))
    keys = held.groupBy("kind", "key").agg(digest.alias("d")).where("d.n > 1").select("kind", "key", mark("d.n", "d.a", "d.b").alias("number"))
    merged = held.join(keys, ["kind", "key"]).select("kind", "domain", "cluster", "number")
    return merged.groupBy("kind", "domain", "cluster").agg(F.sort_array(F.collect_set("number")).alias("keys"))


def _subsets(keys: Column) -> Column:
    """All subsets of keys but the empty one."""
    masks = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size(keys)) - 1)
    return F.transform(masks, lambda m: F.filter(keys, lambda _, i: F.call_function("shiftright", m, i) % 2 == 1))


def pairs_sharing(held: DataFrame, most: int | None = None) -> DataFrame:
    """(kind, same, cross): how many pairs of sites share at least one key of a kind. held: (kind, key, domain, ord, cluster)."""
    most = MOST if most is None else most
    classes = _key_sets(held).groupBy("kind", "keys", "cluster").agg(F.count(F.lit(1)).alias("n"))
    small = classes.where(F.size("keys") <= most)
    sets = small.select("kind", "cluster", "n", F.explode(_subsets(F.col("keys"))).alias("set"))
    parts = sets.groupBy("kind", "set", "cluster").agg(F.sum("n").alias("n"))
    within = F.when(F.col("cluster").isNotNull(), _pairs(F.col("n")))
    sums = parts.groupBy("kind", "set").agg(F.sum("n").alias("n"), F.coalesce(F.sum(within), F.lit(0)).alias("same"))
    sign = F.when(F.size("set") % 2 == 1, F.lit(1)).otherwise(F.lit(-1))
    counted = sums.select("kind", (sign * F.col("same")).alias("same"), (sign * (_pairs(F.col("n")) - F.col("same"))).alias("cross"))
    # Pairs with a site of more keys: of two classes that share one, and within its own class.
    named = classes.withColumn("c", F.xxhash64("keys", F.coalesce("cluster", F.lit("")), F.col("cluster").isNull()))
    each = named.select("kind", "c", "cluster", "n", F.size("keys").alias("size"), F.explode("keys").alias("number"))
    large = each.where(F.col("size") > most).select("kind", "number", F.col("c").alias("x"), F.col("cluster").alias("cx"), F.col("n").alias("nx"))
    other = each.select("kind", "number", F.col("c").alias("y"), F.col("cluster").alias("cy"), F.col("n").alias("ny"), F.col("size").alias("sy"))
    met = large.join(other, ["kind", "number"]).where((F.col("x") != F.col("y")) & ((F.col("sy") <= most) | (F.col("x") < F.col("y")))).drop("number").distinct()
    together = F.coalesce(F.col("cx") == F.col("cy"), F.lit(False))
    apart = met.select("kind", F.when(together, F.col("nx") * F.col("ny")).otherwise(0).alias("same"), F.when(~together, F.col("nx") * F.col("ny")).otherwise(0).alias("cross"))
    own = classes.where(F.size("keys") > most).select("kind", F.when(F.col("cluster").isNotNull(), _pairs(F.col("n"))).otherwise(0).alias("same"), F.when(F.col("cluster").isNull(), _pairs(F.col("n"))).otherwise(0).alias("cross"))
    every = counted.unionByName(apart).unionByName(own)
    return every.groupBy("kind").agg(F.sum("same").cast("long").alias("same"), F.sum("cross").cast("long").alias("cross"))


def finding_counts(signals: DataFrame, sites: DataFrame) -> DataFrame:
    """(type, severity, n): how many findings `correlate.pair_findings` and `correlate.token_findings` have, without making them."""
    rules = F.broadcast(correlate._pair_rules(signals))
    held = members(signals, sites)
    per_key = [r["kind"] for r in correlate._pair_rules(signals).where("per_key").collect()]  # of the rule table
    many = held.where(F.col("kind").isin(*per_key)).withColumn("w", _weight())
    wide = fleet_wide(signals)
    open_ = many.where(~F.col("kind").isin(*SUPPRESSIBLE)).unionByName(many.where(F.col("kind").isin(*SUPPRESSIBLE)).join(wide, "key", "left_anti").select(*many.columns))
    each = links(open_, ["kind", "key"]).groupBy("kind").agg(F.sum("same").alias("same"), F.sum("cross").alias("cross"))
    placed = correlate.pair_signals(signals.where(F.col("kind").isin(*correlate.FIRST)), sites).groupBy("kind").agg(F.count_if("same").alias("same"), F.count_if(~F.col("same")).alias("cross"))
    both = each.unionByName(pairs_sharing(held.where(~F.col("kind").isin(*per_key)))).unionByName(placed).join(rules, "kind")
    sides = F.array(
        F.struct(F.coalesce("type_same", "type").alias("type"), F.col("sev_same").alias("severity"), F.col("same").alias("n")), F.struct(F.col("type"), F.col("sev_cross").alias("severity"), F.col("cross").alias("n"))
    )
    pairs = both.select(F.explode(sides).alias("f")).select("f.*").where("type IS NOT NULL AND severity IS NOT NULL AND n > 0")
    tokens = token_classes(signals, sites).groupBy("type", "severity").agg(F.count(F.lit(1)).alias("n"))
    return pairs.unionByName(tokens).groupBy("type", "severity").agg(F.sum("n").alias("n"))


def token_classes(signals: DataFrame, sites: DataFrame) -> DataFrame:
    """(type, severity, key, n): `correlate.token_findings` without the lists of sites, summed up by cluster first."""
    rules = F.broadcast(signals.sparkSession.createDataFrame([tuple(r) for r in TOKEN_RULES], "kind string, type string, severity string, least int, spans boolean"))
    held = signals.where(F.col("key").isNotNull()).select("domain", "kind", "key").distinct().join(sites.select("domain", "cluster"), "domain")
    parts = held.groupBy("kind", "key", "cluster").agg(F.count(F.lit(1)).alias("n"))
    sums = parts.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.count("cluster").alias("clusters")).join(rules, "kind")
    return sums.where("n >= least AND (NOT spans OR clusters >= 2)").select("type", "severity", "key", "n")


def severity_counts(counts: DataFrame) -> DataFrame:
    """(severity, n) of (type, severity, n)."""
    return counts.groupBy("severity").agg(F.sum("n").alias("n"))


def isolation(counts: DataFrame, sites: DataFrame) -> DataFrame:
    """One row (score, fleet_penalty, pair_penalty, sites), as `correlate.isolation_score`, from (type, severity, n)."""
    base = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PENALTY.items() for x in kv]), F.col("severity")), F.lit(0))
    weight = F.when(F.col("type").isin(*COMMODITY), F.greatest(F.lit(1), F.floor(base * 0.4 + 0.5))).otherwise(base) * F.col("n")
    wide = F.col("type").isin(*FLEET_WIDE)
    sums = counts.agg(F.coalesce(F.sum(F.when(wide, weight)), F.lit(0)).alias("fleet_penalty"), F.coalesce(F.sum(F.when(~wide, weight)), F.lit(0)).alias("pair_penalty"))
    return correlate.score_of(sums, sites)


# Similarity over profiles: sites with the same signals are one node.


def profiles(signals: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(domain, ord, cluster, profile) of sites with signals, and (profile, kind, key, times) of each profile, which is named by its first site."""
    held = members(signals, sites)
    one = F.struct("kind", "key", "times")
    marks = lambda *x: F.sum(F.xxhash64(*x).cast("decimal(38,0)"))
    sums = held.groupBy("domain", "ord", "cluster").agg(F.count(F.lit(1)).alias("n"), marks(one).alias("a"), marks(F.lit("b"), one).alias("b"))
    named = sums.groupBy("n", "a", "b").agg(F.min("ord").alias("profile"))
    placed = sums.join(named, ["n", "a", "b"]).select("domain", "ord", "cluster", "profile")
    leads = placed.where("ord = profile").select("domain", "profile")
    return placed, held.join(leads, "domain").select("profile", "kind", "key", "times")


def _most_points() -> dict[str, int]:
    """The most that a shared key of a kind can add."""
    points = {kind: max(same, cross) for kind, _, _, same, cross, *_ in PAIR_RULES}
    return points | {"form_provider": 12} | {kind: 100 for kind in INSTALLS}


def profile_similarity(own: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, same, cross) of profiles (profile, kind, key, times): points of two, a before b or a itself, for sites of one cluster and of two, if one is at least `least`.

    Keys are ordered by how many profiles hold them. A profile's most common keys that can't add up to `least` lead to no
    comparison: two profiles with as many points share one of its other keys, and the rarest shared one is such a key of both.
    """
    points = F.broadcast(own.sparkSession.createDataFrame(list(_most_points().items()), "kind string, most int"))  # of the rule table
    rare = own.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("holders"))
    ranked = own.join(rare, ["kind", "key"]).join(points, "kind")
    common = Window.partitionBy("profile").orderBy(F.desc("holders"), F.desc("kind"), F.desc("key")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    leading = ranked.withColumn("so_far", F.sum("most").over(common)).where(F.col("so_far") >= least).select("profile", "kind", "key")
    left, right = leading.withColumnRenamed("profile", "a"), leading.withColumnRenamed("profile", "b")
    found = left.join(right, ["kind", "key"]).where("a <= b").select("a", "b").distinct()
    rules = F.broadcast(correlate._pair_rules(own))
    a, b = own.withColumnsRenamed({"profile": "a", "times": "ta"}), own.withColumnsRenamed({"profile": "b", "times": "tb"})
    met = found.join(a, "a").join(b, ["b", "kind", "key"]).join(rules, "kind")
    n = F.when(F.col("kind").isin(*INSTALLS), F.col("ta") * F.col("tb")).otherwise(F.lit(1))
    shared = met.groupBy("a", "b", "kind", "per_key", "pts_same", "pts_cross").agg(F.sum(n).alias("n"))

    def total(pts: str) -> Column:
        each = F.when(F.col("kind") == "form_provider", F.least(F.lit(20), 4 + 8 * F.col("n"))).when(F.col("per_key"), F.col(pts) * F.col("n")).otherwise(F.col(pts))
        return F.least(F.lit(100), F.sum(each)).cast("int")

    return shared.groupBy("a", "b").agg(total("pts_same").alias("same"), total("pts_cross").alias("cross")).where(f"same >= {least} OR cross >= {least}")


def similarity(signals: DataFrame, sites: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, similarity) of all pairs of sites with at least `least` points, as `correlate.similarity`: the profiles' points, dealt to their sites."""
    placed, own = profiles(signals, sites)
    points = profile_similarity(own, least)
    side = lambda x: placed.select(F.col("domain").alias(x), F.col("ord").alias(f"o{x}"), F.col("cluster").alias(f"c{x}"), F.col("profile").alias(f"p{x}"))
    met = points.withColumnsRenamed({"a": "px", "b": "py"}).join(side("x"), "px").join(side("y"), "py").where("px < py OR ox < oy")
    points = F.when(F.col("cx") == F.col("cy"), F.col("same")).otherwise(F.col("cross"))
    first = F.col("ox") < F.col("oy")
    return met.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"), points.alias("similarity")).where(F.col("similarity") >= least)


def matrix(pairs: DataFrame, sites: DataFrame, block: int = 20) -> DataFrame:
    """(row_block, col_block, domain, c00, c01, ...): the similarity matrix in blocks of `block` sites by their order, 100 on the diagonal, 0 where nothing is shared."""
    # Places by ranges of ord: counts of the ranges before, then a number within the range.
    ranged = sites.select("domain", "ord").withColumn("range", F.floor(F.col("ord") / 4096))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("k")).select("range", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("begin"))
    within = F.row_number().over(Window.partitionBy("range").orderBy("ord")) - 1
    placed = ranged.withColumn("within", within).join(starts, "range").select("domain", (F.col("begin") + F.col("within")).alias("i"))
    both = pairs.select("a", "b", "similarity").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    both = both.unionByName(sites.select(F.col("domain").alias("a"), F.col("domain").alias("b"), F.lit(100).alias("similarity")))
    cells = both.join(placed.withColumnsRenamed({"domain": "a", "i": "ia"}), "a").join(placed.withColumnsRenamed({"domain": "b", "i": "ib"}), "b")
    cells = cells.select(F.floor(F.col("ia") / block).cast("int").alias("row_block"), F.floor(F.col("ib") / block).cast("int").alias("col_block"), F.col("a").alias("domain"), (F.col("ib") % block).cast("int").alias("c"), "similarity")
    wide = cells.groupBy("row_block", "col_block", "domain").pivot("c", list(range(block))).agg(F.max("similarity"))
    return wide.select("row_block", "col_block", "domain", *[F.coalesce(F.col(str(k)), F.lit(0)).cast("int").alias(f"c{k:02d}") for k in range(block)])
