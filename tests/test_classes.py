"""Classes and counts against pairs, on random fleets with copies, hot keys, many keys a site, and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import classes, correlate, identifiers
from tessera.registry import PAIR_RULES

KINDS = [r[0] for r in PAIR_RULES if r[0] not in ("sitemap_path", "cookie")]
SIGNALS, SITES = "domain string, kind string, key string, times long", "domain string, ord long, cluster string"


def fleet(spark, seed, n=60, keys=4):
    dice = random.Random(seed)
    sites = [(f"s{k}.example", 3 * k + 7, dice.choice(["red", "blue", "Adult x", None])) for k in range(n)]
    rows = []
    for k, (domain, *_) in enumerate(sites):
        if k % 3 == 2:  # the same as the site before
            rows += [(domain, *r[1:]) for r in rows if r[0] == sites[k - 1][0]]
            continue
        rows.append((domain, "head", "hot", 1))
        for _ in range(dice.randrange(keys * 3)):
            rows.append((domain, dice.choice(KINDS), dice.choice([f"k{x}" for x in range(keys)] + ["k" * 24, None]), dice.choice([1, 1, 1, 2, 3])))
    rows.append(("nosite.example", "ip", "k1", 1))
    seen = {}
    for d, kind, key, t in rows:
        seen[d, kind, key] = t
    return spark.createDataFrame([(*k, v) for k, v in seen.items()], SIGNALS), spark.createDataFrame(sites, SITES)


def counted(df, *columns):
    return sorted(map(tuple, df.groupBy(*columns).count().collect()), key=str)


@pytest.mark.parametrize("seed, most", [(1, 8), (2, 1), (3, 0), (4, 2)])
def test_counts_and_scores_are_those_of_the_pairs(spark, monkeypatch, seed, most):
    monkeypatch.setattr(classes, "MOST", most)
    signals, sites = fleet(spark, seed)
    signals = signals.cache()
    pairs, tokens = correlate.pair_findings(signals, sites).cache(), correlate.token_findings(signals, sites).cache()
    both = pairs.select("type", "severity").unionByName(tokens.select("type", "severity")).cache()
    counts = classes.finding_counts(signals, sites).cache()
    assert sorted(map(tuple, counts.collect())) == counted(both, "type", "severity") and both.count() > 500
    assert sorted(map(tuple, classes.severity_counts(counts).collect())) == counted(both, "severity")
    assert classes.isolation(counts, sites).collect() == correlate.isolation_score(both, sites).collect()
    assert sorted(map(tuple, classes.token_classes(signals, sites).collect())) == sorted((r.type, r.severity, r.key, r.n) for r in tokens.collect())


@pytest.mark.parametrize("least", [1, 30, 70])
def test_similarity_of_profiles_is_that_of_the_pairs(spark, least):
    signals, sites = fleet(spark, 9)
    want = sorted(map(tuple, correlate.similarity(signals, sites).where(F.col("similarity") >= least).collect()))
    assert sorted(map(tuple, classes.similarity(signals, sites, least).collect())) == want and want


def test_classes_expand_to_the_links(spark):
    signals, sites = fleet(spark, 5)
    found = {(r.kind, r.key): r for r in classes.key_classes(signals, sites).collect()}
    held = {}
    for r in classes.members(signals, sites).collect():
        held.setdefault((r.kind, r.key), []).append(r)
    want = {k: sorted(v, key=lambda r: r.ord) for k, v in held.items() if len(v) > 1 and k[0] in {r[0] for r in PAIR_RULES}}
    assert set(found) == set(want) and len(want) > 20
    for k, rows in want.items():
        links = [(a, b, a.times * b.times if k[0] == "umami_src" else 1) for i, a in enumerate(rows) for b in rows[i + 1 :]]
        same = sum(w for a, b, w in links if a.cluster is not None and a.cluster == b.cluster)
        assert (found[k].n, found[k].first, found[k].links_same, found[k].links_cross) == (len(rows), rows[0].domain, same, sum(w for *_, w in links) - same)
    tree = sorted((r.kind, r.key, r.first, r.domain) for r in classes.representatives(signals, sites).collect())
    assert tree == sorted((*k, rows[0].domain, r.domain) for k, rows in want.items() for r in rows[1:])


def test_no_rows_by_pairs_for_a_key_of_all_sites(spark):
    """3,000 sites of one key: the counts come without a join of sites with sites."""
    sites = spark.range(3000).select(F.format_string("s%d.example", "id").alias("domain"), F.col("id").alias("ord"), F.when(F.col("id") % 3 > 0, F.format_string("c%d", F.col("id") % 3)).alias("cluster"))
    signals = sites.select("domain", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("key")) for k, v in (("body", "x"), ("comment", "a"), ("comment", "b"), ("gtm", "GTM-1"))])).alias("s")).select("domain", "s.*", F.lit(1).cast("long").alias("times"))
    counts = {(r.type, r.severity): r.n for r in classes.finding_counts(signals, sites).collect()}
    same, every = 2 * (1000 * 999 // 2), 3000 * 2999 // 2
    assert counts == {("shared-body-structure", "medium"): same, ("shared-body-structure", "high"): every - same, ("shared-comments", "low"): every, ("fleet-wide-tracking-id", "critical"): 1}
    assert classes.profiles(signals, sites)[0].select("profile").distinct().count() == 1


def test_empty_tables(spark):
    signals, sites = fleet(spark, 5)
    none = signals.limit(0)
    assert classes.finding_counts(none, sites).count() == classes.similarity(none, sites).count() == classes.key_classes(none, sites).count() == 0
    assert classes.isolation(classes.finding_counts(none, sites), sites).first().score == 100
    assert classes.finding_counts(signals, sites.limit(0)).count() == 0


def test_matrix_blocks(spark):
    sites = spark.createDataFrame([(f"s{k}", 5000 * k, None) for k in range(7)], SITES)
    pairs = spark.createDataFrame([("s0", "s5", 40), ("s1", "s2", 70)], "a string, b string, similarity int")
    rows = {(r.row_block, r.col_block, r.domain): [r.c00, r.c01, r.c02] for r in classes.matrix(pairs, sites, 3).collect()}
    assert rows[0, 0, "s1"] == [0, 100, 70] and rows[0, 1, "s0"] == [0, 0, 40] and rows[1, 0, "s5"] == [40, 0, 0] and rows[2, 2, "s6"] == [100, 0, 0]
    assert len(rows) == 9


def plain_umami(html):
    import re

    sources = [(m.start(), m[1]) for m in re.finditer(r"""src=['"]([^'"]*umami[^'"]*\.js)['"]""", html)]
    ids = [(m.start(), m[1]) for m in re.finditer(r"""data-website-id=['"]([0-9a-f-]{36})['"]""", html)]
    out = {}
    for at, src in sources:
        if ids:
            out.setdefault(min(ids, key=lambda x: abs(x[0] - at))[1], src)
    return out


def test_nearest_website_id(spark):
    dice = random.Random(2)
    pages = []
    for k in range(150):
        parts = [dice.choice([f'src="/{dice.randrange(4)}umami.js"', f"data-website-id='0000000{dice.randrange(4)}-89ab-cdef-0123-456789abcdef'", "x" * dice.randrange(30), "src='/other.js'", "umami"]) for _ in range(dice.randrange(12))]
        pages.append((k, "".join(parts)))
    pages += [(1000, ""), (1001, None), (1002, "umami")]
    got = {}
    for r in identifiers.umami_pairs(spark.createDataFrame(pages, "page_id long, html string")).collect():
        got.setdefault(r.page_id, {})[r.website_id] = r.src
    assert got == {k: v for k, h in pages if (v := plain_umami(h or ""))} and len(got) > 50
