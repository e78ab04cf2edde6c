"""What sites share: an inverted index of signals, joined on their keys and scored by rule tables.

signals: (domain, kind, key), one row an observed key; sites: (domain, ord, cluster), a row a site, ord unique, cluster null
for unclustered sites. A pair of sites meets only on a shared key. A key that n sites hold makes n * (n - 1) / 2 pairs, as
pair findings are asked for; `token_findings` makes one row of such a key instead.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tessera.registry import COLLAPSE, COMMODITY, DEFAULT_SITEMAP, FLEET_WIDE, PAIR_RULES, PENALTY, SUPPRESSIBLE, TOKEN_RULES
from tessera.sources import tables


#: Kinds of which each pair of installs counts, and kinds whose repeats at the first site of a pair count.
INSTALLS, REPEATING = ("umami_src",), ("inline_script", "comment")
#: Kinds of which the first shared key, in the order of a pair's first site, decides: none is told if it is this one.
FIRST = {"sitemap_path": DEFAULT_SITEMAP, "cookie": ""}
#: Points of two sites registered within a week.
REGISTRATION_POINTS = 10


def _pair_rules(signals: DataFrame) -> DataFrame:
    schema = "kind string, type string, type_same string, pts_same int, pts_cross int, sev_same string, sev_cross string, per_key boolean"
    return signals.sparkSession.createDataFrame([tuple(r) for r in PAIR_RULES], schema)


def pair_signals(signals: DataFrame, sites: DataFrame) -> DataFrame:
    """(a, b, kind, same, n, wide, detail, rule columns): what each pair of sites, a before b, shares of a kind, or for rules
    that count each key, of a kind and key; wide: whether the key is a fleet-wide one, whose finding is made elsewhere."""
    rules = F.broadcast(_pair_rules(signals))  # of fixed size
    # Without a column `times`, the rows of a site and key are how often it holds the key.
    times = F.sum(F.col("times") if "times" in signals.columns else F.lit(1)).cast("long").alias("times")
    place = F.min(F.col("pos") if "pos" in signals.columns else F.lit(0)).alias("pos")
    own = signals.where(F.col("key").isNotNull()).groupBy("domain", "kind", "key").agg(times, place).join(sites, "domain")
    # Ids count as fleet-wide by their occurrences, whichever kind they are of.
    counts = own.where(F.col("kind").isin(*SUPPRESSIBLE, "umami_id")).groupBy("key").agg((F.sum("times") >= 3).alias("wide"))
    left = own.join(counts, "key", "left").select("kind", "key", F.col("domain").alias("a"), F.col("ord").alias("oa"), F.col("cluster").alias("ca"), F.col("times").alias("ta"), F.struct("pos", "key").alias("place"), F.coalesce("wide", F.lit(False)).alias("wide"))
    right = own.select("kind", "key", F.col("domain").alias("b"), F.col("ord").alias("ob"), F.col("cluster").alias("cb"), F.col("times").alias("tb"))
    met = left.join(right, ["kind", "key"]).where("oa < ob AND NOT (kind = 'cloudflare' AND length(key) < 20)")
    # Repeats at the first site count for lists that keep them; of installs each pair counts.
    n = F.when(F.col("kind").isin(*INSTALLS), F.col("ta") * F.col("tb")).when(F.col("kind").isin(*REPEATING), F.col("ta")).otherwise(1)
    same = F.coalesce(F.col("ca") == F.col("cb"), F.lit(False))
    shared = met.withColumn("same", same).join(rules, "kind").withColumn("one", F.when(F.col("per_key"), F.col("key")))
    keys = ["a", "b", "kind", "same", "one", "type", "type_same", "pts_same", "pts_cross", "sev_same", "sev_cross", "per_key"]
    out = shared.groupBy(*keys).agg(F.sum(n).alias("n"), F.min("wide").alias("wide"), F.min("place").alias("lead"), F.array_join(F.sort_array(F.collect_list("key")), ", ").alias("detail"))
    for kind, usual in FIRST.items():
        out = out.where((F.col("kind") != kind) | (F.col("lead.key") != usual))
    return out.drop("lead")


def similarity(signals: DataFrame, sites: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity): points added up, at most 100; near: pairs (a, b) that were registered about the same time."""
    each = F.when(F.col("same"), F.col("pts_same")).otherwise(F.col("pts_cross"))
    points = F.when(F.col("kind") == "form_provider", F.least(F.lit(20), 4 + 8 * F.col("n"))).when(F.col("per_key"), each * F.col("n")).otherwise(each)
    each_pair = pair_signals(signals, sites).select("a", "b", points.cast("long").alias("p"))
    if near is not None:
        each_pair = each_pair.unionByName(near.select("a", "b", F.lit(REGISTRATION_POINTS).cast("long").alias("p")))
    total = each_pair.groupBy("a", "b").agg(F.sum("p").alias("p"))
    return total.select("a", "b", F.least(F.lit(100), F.col("p")).cast("int").alias("similarity")).where("similarity > 0")


def pair_findings(signals: DataFrame, sites: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """(type, severity, a, b, n, detail): findings of pairs, of some rules one for each key; fleet-wide keys leave them."""
    kind = F.when(F.col("same"), F.coalesce("type_same", "type")).otherwise(F.col("type"))
    out = pair_signals(signals, sites).where(~F.col("kind").isin(*SUPPRESSIBLE) | ~F.col("wide"))
    severity = F.when(F.col("same"), F.col("sev_same")).otherwise(F.col("sev_cross"))
    installs = F.col("kind").isin(*INSTALLS)  # each pair of them is a finding
    out = out.withColumn("each", F.explode(F.when(installs, F.sequence(F.lit(1).cast("long"), F.col("n"))).otherwise(F.array(F.lit(1).cast("long")))))
    out = out.select(kind.alias("type"), severity.alias("severity"), "a", "b", F.when(installs, 1).otherwise(F.col("n")).cast("long").alias("n"), "detail").where("type IS NOT NULL AND severity IS NOT NULL")
    if near is None:
        return out
    dates = near.select(F.lit("registration-proximity").alias("type"), F.lit("medium").alias("severity"), "a", "b", F.lit(1).cast("long").alias("n"), F.col("days").cast("string").alias("detail"))
    return out.unionByName(dates)


def registration_pairs(registrations: DataFrame, days: int = 7) -> DataFrame:
    """(a, b, days): sites (domain, ord, created timestamp) registered less than so many days apart.

    A range join by buckets of that many days: a site is joined with its own bucket and the next, so only near sites meet.
    """
    seconds = days * 86400
    rows = registrations.where("created IS NOT NULL").select("domain", "ord", F.unix_timestamp("created").alias("t"))
    rows = rows.withColumn("bucket", F.floor(F.col("t") / seconds))
    left = rows.select(F.col("domain").alias("x"), F.col("ord").alias("ox"), F.col("t").alias("tx"), F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("bucket"), F.col("bucket").alias("bx"))
    right = rows.select(F.col("domain").alias("y"), F.col("ord").alias("oy"), F.col("t").alias("ty"), "bucket")
    near = (F.abs(F.col("tx") - F.col("ty")) < seconds) & ((F.col("bucket") > F.col("bx")) | (F.col("ox") < F.col("oy")))
    met = left.join(right, "bucket").where(near)
    first = F.col("ox") < F.col("oy")
    return met.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"), F.round(F.abs(F.col("tx") - F.col("ty")) / 86400).cast("int").alias("days"))


def token_findings(signals: DataFrame, sites: DataFrame) -> DataFrame:
    """(type, severity, key, n, domains): keys that enough sites hold; domains are sorted and joined by a comma."""
    rules = signals.sparkSession.createDataFrame([tuple(r) for r in TOKEN_RULES], "kind string, type string, severity string, least int, spans boolean")
    held = signals.where(F.col("key").isNotNull()).select("domain", "kind", "key").distinct().join(sites, "domain").join(F.broadcast(rules), "kind")
    sums = held.groupBy("kind", "type", "severity", "key", "least", "spans").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cluster").alias("clusters"), F.array_join(F.sort_array(F.collect_list("domain")), ",").alias("domains"))
    return sums.where("n >= least AND (NOT spans OR clusters >= 2)").select("type", "severity", "key", "n", "domains")


def suffix_findings(mentions: DataFrame, sites: DataFrame, kind: str, severity: str = "critical", key: str | None = None) -> DataFrame:
    """(type, severity, domain, target): sites whose records (domain, host) name a host under another site of the fleet; with
    `key`, a column of mentions, a row for each of its values.

    Each host is exploded into its suffixes, which makes "is under" an equi-join.
    """
    parts = F.split(F.lower("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    under = lambda x, y: (x == y) | x.endswith(F.concat(F.lit("."), y))
    more = [key] if key else []
    each = mentions.where(F.col("host").isNotNull()).select("domain", "host", *more, F.explode(suffixes).alias("target"))
    fleet = sites.select(F.lower("domain").alias("target"), F.col("ord"))
    own, other = F.lower("domain"), F.col("target")
    met = each.join(fleet, "target").where(~under(own, other) & ~under(other, own) & ~under(F.lower("host"), own))
    first = met.groupBy("domain", "host", *more).agg(F.min_by("target", "ord").alias("target"))
    return first.select(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), "domain", "target", *more).distinct()


def cross_cluster(sites: DataFrame, flags: DataFrame) -> DataFrame:
    """(type, severity, domain) for adult signals (domain, signal in adult, adult-ads, adult-affiliate) on clean clusters."""
    clean = sites.where(~F.coalesce(F.lower(F.trim("cluster")).startswith("adult"), F.lit(False)))
    name = F.when(F.col("signal") == "adult", "cross-cluster-adult").otherwise(F.concat(F.lit("cross-cluster-"), "signal"))
    return flags.distinct().join(clean, "domain").select(name.alias("type"), F.lit("critical").alias("severity"), "domain")


def severity_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def isolation_score(findings: DataFrame, sites: DataFrame) -> DataFrame:
    """One row (score, fleet_penalty, pair_penalty, sites) from findings (type, severity)."""
    base = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PENALTY.items() for x in kv]), F.col("severity")), F.lit(0))
    weight = F.when(F.col("type").isin(*COMMODITY), F.greatest(F.lit(1), F.floor(base * 0.4 + 0.5))).otherwise(base)
    wide = F.col("type").isin(*FLEET_WIDE)
    sums = findings.agg(F.coalesce(F.sum(F.when(wide, weight)), F.lit(0)).alias("fleet_penalty"), F.coalesce(F.sum(F.when(~wide, weight)), F.lit(0)).alias("pair_penalty"))
    return score_of(sums, sites)


def score_of(sums: DataFrame, sites: DataFrame) -> DataFrame:
    """(score, fleet_penalty, pair_penalty, sites) of one row of penalties; those of pairs are shared out over the pairs."""
    n = F.col("sites")
    over = F.greatest(F.lit(1), F.ceil(F.greatest(F.lit(1.0), n * (n - 1) / 2) / 3))
    both = sums.crossJoin(sites.agg(F.count(F.lit(1)).alias("sites")))  # one row each
    return both.select(F.greatest(F.lit(0), 100 - F.col("fleet_penalty") - F.floor(F.col("pair_penalty") / over + 0.5)).cast("int").alias("score"), F.col("fleet_penalty").cast("long").alias("fleet_penalty"), F.col("pair_penalty").cast("long").alias("pair_penalty"), "sites")


def collapse(findings: DataFrame, rollups: DataFrame, least: int = 3) -> DataFrame:
    """(type, severity, detail, pairs, domains): what is shown of pair findings (type, severity, a, b, detail).

    Commodity findings of one detail become one line if they are of at least so many pairs; they leave if a fleet-wide
    rollup (type fleet-wide-form-provider, domains joined by commas) has all their sites. All others stay as they are.
    """
    rank = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 1).otherwise(0)
    some = F.col("type").isin(*COLLAPSE)
    keys = ["type", "detail"]
    groups = findings.where(some).groupBy(*keys).agg(F.max_by("severity", rank).alias("most"), F.count(F.lit(1)).alias("pairs"), F.array_sort(F.array_distinct(F.concat(F.collect_set("a"), F.collect_set("b")))).alias("all"))
    # Of the rollups only the number of a group's sites in each is needed.
    provider = F.col("type") == "shared-form-provider"
    members = groups.where(provider).select(*keys, F.size("all").alias("size"), F.explode("all").alias("site"))
    have = rollups.select(F.col("domains").alias("r"), F.explode(F.split("domains", ",")).alias("site")).distinct()
    covered = members.join(have, "site").groupBy(*keys, "size", "r").agg(F.count(F.lit(1)).alias("n")).where("n = size").select(*keys).distinct()
    groups = groups.join(covered, keys, "left_anti")
    lines = groups.where(F.col("pairs") >= least).select("type", F.col("most").alias("severity"), "detail", "pairs", F.array_join("all", ",").alias("domains"))
    pair = lambda df: df.select("type", "severity", "detail", F.lit(1).cast("long").alias("pairs"), F.concat_ws(",", "a", "b").alias("domains"))
    small = findings.where(some).join(groups.where(F.col("pairs") < least).select(*keys), keys)
    return lines.unionByName(pair(small)).unionByName(pair(findings.where(~some)))


def unreachable(scans: DataFrame) -> DataFrame:
    """(domain, reason) of scan records whose site gave no content: an HTTP error status, a failed http scan, or neither."""
    status = F.col("http.statusCode")
    error = F.get(F.filter(F.coalesce("errors", F.array().cast("array<struct<scanner:string,error:string>>")), lambda e: e["scanner"] == "http"), F.lit(0))["error"]
    down = F.col("http").isNull() | (status >= 400)
    return scans.where(down).select("domain", F.coalesce(F.when(status >= 400, F.concat(F.lit("HTTP "), status.cast("string"))), error, F.lit("no response")).alias("reason"))


#: Pairs that a task makes and adds up: some hundred megabytes of them.
TASK_PAIRS = 2_000_000


def shared_counts(own: DataFrame, owner: str, key: str, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """(a, b, n): how many keys two owners share, a < b; own: (owner, key), repeated or not, read once.

    A small table can make very many pairs, so pairs aren't shuffled: each task gets a range of owners that are the first of about
    `task_pairs` pairs and, of each key that one of them holds, the key's owners from there on. It makes all pairs of its owners and adds
    them up. An owner with more pairs has several tasks, which share out the second owners. A key's owners are one row, as n of them make
    n * (n - 1) / 2 pairs anyway.
    """
    held = own.where(F.col(owner).isNotNull() & F.col(key).isNotNull())
    lists = tables.stored(held.groupBy(key).agg(F.array_sort(F.collect_set(owner)).alias("all")).where("size(all) > 1").select("all"), "owners-of-keys")
    tasks, cuts = _ranges(lists, task_pairs)
    column = lambda name: F.array(*[F.lit(c[name]) for c in cuts])
    lows, firsts, shares = column("low").cast(lists.schema["all"].dataType), column("task"), column("shares")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, len(cuts)).bit_length()))])
    place = lambda x: F.aggregate(steps, F.lit(0), lambda i, step: F.when(F.get(lows, i + step - 1) <= x, i + step).otherwise(i))
    of = lists.select("all", F.explode(F.array_distinct(F.transform("all", place))).alias("i"))
    of = of.select("all", F.get(lows, F.col("i") - 1).alias("low"), F.get(lows, F.col("i")).alias("high"), F.get(firsts, F.col("i") - 1).alias("task"), F.get(shares, F.col("i") - 1).alias("shares"))
    mine = lambda x, share: (F.col("shares") == 1) | (x == F.col("low")) | (F.pmod(F.xxhash64(x), F.col("shares")) == share)
    rests = F.transform(F.sequence(F.lit(0), F.col("shares") - 1), lambda share: F.filter("all", lambda x: (x >= F.col("low")) & mine(x, share)))
    of = of.select("task", "high", F.posexplode(rests).alias("share", "rest")).where("size(rest) > 1")
    met = of.select((F.col("task") + F.col("share")).alias("task"), F.size(F.filter("rest", lambda x: F.coalesce(x < F.col("high"), F.lit(True)))).alias("n"), "rest")
    met = met.repartitionById(tasks, F.col("task")).select("task", F.explode(F.slice("rest", 1, F.col("n"))).alias("a"), "rest")
    # A pair's owners meet in one task only, which Spark is told by `task` among the columns.
    return met.select("task", "a", F.explode("rest").alias("b")).where("a < b").groupBy("task", "a", "b").agg(F.count(F.lit(1)).alias("n")).drop("task")


def _ranges(lists: DataFrame, task_pairs: int) -> tuple[int, list[Row]]:
    """The number of tasks and (task, shares, low): ranges of owners, by their lowest one, with their first task and how many they have.

    The pairs stand in the order of their first owners; an owner's task is told by the pairs before its own.
    """
    each = lists.select(F.size("all").alias("n"), F.posexplode("all").alias("at", "owner"))
    led = each.groupBy("owner").agg(F.sum(F.col("n") - 1 - F.col("at")).alias("pairs")).repartitionByRange("owner")
    led = tables.stored(led.withColumn("part", F.spark_partition_id()), "pairs-of-owners")  # ranges are drawn anew each time
    sums = led.groupBy("part").agg(F.sum("pairs").alias("pairs")).orderBy("part").collect()  # a row a partition
    before = dict(zip([r.part for r in sums], accumulate([r.pairs for r in sums], initial=0)))
    total = sum(r.pairs for r in sums)
    tasks = max(1, int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // task_pairs))
    if not total:
        return tasks, []
    each_task = -(-total // tasks)
    earlier = F.coalesce(F.sum("pairs").over(Window.partitionBy("part").orderBy("owner").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.get(F.array(*[F.lit(before.get(part, 0)) for part in range(sums[-1].part + 1)]), F.col("part")) + earlier
    task, shares = F.least(F.lit(tasks - 1), F.floor(start / each_task)), F.greatest(F.lit(1), F.floor(F.col("pairs") / each_task))
    ranges = led.select("owner", task.cast("int").alias("task"), shares.cast("int").alias("shares"))
    return tasks, ranges.groupBy("task", "shares").agg(F.min("owner").alias("low")).orderBy("low").collect()  # a row or two a task
