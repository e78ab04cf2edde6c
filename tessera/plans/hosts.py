"""Queries on the hosts of the page table: what they share, as classes, counts, scores and pairs, and the SQL for each.

The pages are those of `queries`, with more markup by page_id (VARIANTS), which both engines put together from the same expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import classes, correlate, hosts, identifiers
from tessera.plans import fixtures as fx
from tessera.plans.queries import _FACTS, _BODY_HASH, _HEAD_HASH, _ISOLATION, _KINDS, _TOKENS, Query, _all, _meta_sql, _pages, _rules_sql, q
from tessera.registry import ACCOUNT_IDS, ACCOUNT_KINDS, CRITICAL_ACCOUNTS, FORM_ENDPOINTS, IGNORED_ACCOUNTS, PREFIX
from tessera.sources import tables

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str):
    def put(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return put


_ID = "lpad(CAST(page_id % {0} AS VARCHAR(9)), 8, '0') || '-89ab-cdef-0123-456789abcdef'"
_SITE = "'data-website-id=\"' || " + _ID + " || '\" '"
_SRC = "'src=\"https://s' || CAST(page_id % {0} AS VARCHAR(9)) || '.example/umami{1}.js\" '"
#: Sources and ids of Umami installs in all orders: ids before and behind, as far on both sides, two sources for one id, none; and lists with repeats.
VARIANTS = (
    f"'<script ' || {_SRC.format(3, 'a')} || {_SITE.format(5)} || '></script><script ' || {_SITE.format(7)} || {_SRC.format(4, 'b')} || '></script>'",
    f"'<i ' || {_SITE.format(4)} || '></i> <b ' || {_SRC.format(2, 'c')} || '></b> <u ' || {_SITE.format(9)} || '></u><b ' || {_SRC.format(5, 'd')} || '></b>'",
    f"'<b ' || {_SRC.format(3, 'e')} || '></b><b ' || {_SRC.format(2, 'f')} || '></b>' || repeat('x', CAST(page_id % 40 AS INT)) || '<i ' || {_SITE.format(3)} || '></i>'",
    "'<!-- shared note --><!-- shared note --><script>var repeated = 1234567;</script><script>var repeated = 1234567;</script><b src=\"/umami-alone.js\"></b>'",
    "'<!-- note ' || CAST(page_id % 3 AS VARCHAR(9)) || ' of three --><script>window.part = ' || CAST(page_id % 2 AS VARCHAR(9)) || ' + 1;</script><META CONTENT=\"Gen ' || CAST(page_id % 2 AS VARCHAR(9)) || '\" NAME=\"generator\">'",
    "''",
)
_MARKED = f"CASE CAST(page_id % {len(VARIANTS)} AS INT) " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(VARIANTS)) + " END"


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).withColumn("html", F.expr(f"html || {_MARKED.replace('VARCHAR(9)', 'STRING')}"))


_P = f"p AS (SELECT page_id, url, host, html || {_MARKED} AS html FROM ({fx.PAGES}))"
_SOURCE, _WEBSITE = (next(p for n, p in ACCOUNT_IDS if n == name) for name in ("Umami Script Source", "Umami Website ID"))
_EITHER = q(f"{_SOURCE}|{_WEBSITE}")
_UMAMI = f"""umami_tok AS (SELECT page_id, x[1] AS m, x[2] AS g, x[3] AS n FROM (
    SELECT page_id, unnest(list_zip(regexp_extract_all(html, {_EITHER}), list_transform(regexp_split_to_array(html, {_EITHER}), lambda t: length(t)), range(1000000))) AS x FROM p) WHERE x[1] IS NOT NULL),
  place AS (SELECT page_id, n, m LIKE 'src%' AS source, regexp_extract(m, '=[''"]([^''"]*)', 1) AS value, sum(g + length(m)) OVER (PARTITION BY page_id ORDER BY n) - length(m) AS at FROM umami_tok),
  near AS (SELECT s.page_id, s.n, s.value AS src, arg_min(i.value, (abs(s.at - i.at), i.n)) AS website_id FROM place s JOIN place i ON s.page_id = i.page_id AND s.source AND NOT i.source GROUP BY ALL),
  umami AS (SELECT page_id, website_id, arg_min(src, n) AS src FROM near GROUP BY page_id, website_id)"""


@_add("umami_installs", f"WITH {_P}, {_UMAMI} SELECT page_id, website_id, src FROM umami")
def umami_installs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifiers.umami_pairs(marked(spark, sf_dir))


_OTHER = f"name NOT IN ({', '.join(map(q, (*ACCOUNT_KINDS, 'Plausible Domain', *IGNORED_ACCOUNTS)))})"
_KIND_OF = (
    "CASE " + " ".join(f"WHEN name = {q(n)} THEN '{k}'" for n, k in ACCOUNT_KINDS.items()) + f" WHEN name = 'Plausible Domain' THEN CASE WHEN regexp_matches(id, '\\.js(?:\\?|$)') OR contains(id, '/') THEN CASE WHEN NOT contains(id, 'plausible.io/') THEN 'plausible_src' END ELSE 'plausible_domain' END"
    f" WHEN {_OTHER} THEN CASE WHEN name IN ({', '.join(map(q, CRITICAL_ACCOUNTS))}) THEN 'account_critical' ELSE 'account_high' END END"
)
_ACCOUNTS = "acc AS (SELECT DISTINCT page_id, host, name, id FROM (" + " UNION ALL ".join(f"SELECT page_id, host, {q(n)} AS name, '{PREFIX.get(n, '')}' || unnest({_all(x)}) AS id FROM p" for n, x in ACCOUNT_IDS if n != "Umami Script Source") + "))"
_MANY = {
    "inline_script": _FACTS["inline_script"], "css": _FACTS["inline_style"], "comment": _FACTS["comment"], "email": _FACTS["email"],
    "font": f"list_transform({_FACTS['font_source']}, lambda u: string_split(string_split(u, '/')[-1], '?')[1])", "form_endpoint": "list_distinct(list_concat(" + ", ".join(_all(x) for x in FORM_ENDPOINTS) + "))",
    "sameas": """list_distinct(flatten(list_transform(regexp_extract_all(html, '(?i)<script[^>]+type=["'']application/ld\\+json["''][^>]*>([\\s\\S]*?)</script>', 1), lambda j: CAST(CAST(j AS JSON)->'sameAs' AS VARCHAR[]))))""",
}
_ONE = {"head": _HEAD_HASH, "body": _BODY_HASH, "generator": _meta_sql("generator"), "twitter_site": """nullif(regexp_extract(html, '(?i)<meta[^>]+name="twitter:site"[^>]+content="([^"]*)"', 1), '')"""}
_HOSTS = f"""WITH {_P}, {_ACCOUNTS}, {_UMAMI},
  one AS ({" UNION ALL ".join(f"SELECT host, page_id, '{k}' AS kind, {v} AS key FROM p" for k, v in _ONE.items())}),
  many AS ({" UNION ALL ".join(f"SELECT host, '{k}' AS kind, unnest({v}) AS key FROM p" for k, v in _MANY.items())} UNION ALL SELECT host, {_KIND_OF}, CASE WHEN {_OTHER} THEN name || chr(9) || id ELSE id END FROM acc),
  install AS (SELECT host, website_id, arg_min(src, page_id) AS key FROM umami JOIN p USING (page_id) WHERE src <> '' GROUP BY ALL),
  signals AS (SELECT host AS domain, kind, arg_min(key, page_id) AS key, CAST(1 AS BIGINT) AS times FROM one WHERE key IS NOT NULL AND key <> '' GROUP BY host, kind
    UNION ALL SELECT host, kind, key, count(*) FROM many WHERE kind IS NOT NULL AND key IS NOT NULL GROUP BY ALL UNION ALL SELECT host, 'umami_src', key, count(*) FROM install GROUP BY ALL),
  sites AS (SELECT host AS domain, min(page_id) AS ord, regexp_extract(host, '([^.]+\\.[^.]+)$', 1) AS cluster FROM p GROUP BY host)"""
_PAIRS = f"""o AS (SELECT s.domain, s.kind, s.key, s.times, i.ord, i.cluster FROM signals s JOIN sites i USING (domain) WHERE s.key IS NOT NULL AND NOT (s.kind = 'cloudflare' AND length(s.key) < 20)),
  wide AS (SELECT key FROM signals WHERE kind IN ({_KINDS}, 'umami_id') GROUP BY key HAVING sum(times) >= 3), {_rules_sql()},
  m AS (SELECT a.domain AS a, b.domain AS b, a.kind, coalesce(a.cluster = b.cluster, false) AS same, CASE WHEN r.per_key THEN a.key END AS one, CAST(sum(CASE WHEN a.kind = 'umami_src' THEN a.times * b.times WHEN a.kind IN ('inline_script', 'comment') THEN a.times ELSE 1 END) AS BIGINT) AS n,
    bool_and(w.key IS NOT NULL) AS wide, string_agg(a.key, ', ' ORDER BY a.key) AS detail
    FROM o a JOIN o b ON a.kind = b.kind AND a.key = b.key AND a.ord < b.ord JOIN r ON r.kind = a.kind LEFT JOIN wide w ON w.key = a.key GROUP BY ALL),
  f AS (SELECT kind, CASE WHEN same THEN coalesce(type_same, type) ELSE type END AS type, CASE WHEN same THEN sev_same ELSE sev_cross END AS severity, a, b, n, detail FROM m JOIN r USING (kind) WHERE NOT (kind IN ({_KINDS}) AND wide)),
  pair AS (SELECT type, severity, a, b, n, detail FROM f WHERE kind <> 'umami_src' AND type IS NOT NULL AND severity IS NOT NULL UNION ALL SELECT type, severity, a, b, CAST(1 AS BIGINT), detail FROM (SELECT *, unnest(range(n)) FROM f WHERE kind = 'umami_src'))"""
_POINTS = """points AS (SELECT a, b, CAST(least(100, p) AS INTEGER) AS similarity FROM (SELECT a, b, sum(CASE WHEN kind = 'form_provider' THEN least(20, 4 + 8 * n) WHEN per_key THEN n * (CASE WHEN same THEN pts_same ELSE pts_cross END)
  ELSE CASE WHEN same THEN pts_same ELSE pts_cross END END) AS p FROM m JOIN r USING (kind) GROUP BY a, b) WHERE p > 0)"""
_ALL = f"{_HOSTS}, {_PAIRS}, {_TOKENS}, allf AS (SELECT type, severity FROM pair UNION ALL SELECT type, severity FROM token)"


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = marked(spark, sf_dir)
    return tables.stored(hosts.signals(pages), "host-signals"), tables.stored(hosts.sites(pages), "host-sites")


@_add("host_signals", f"{_HOSTS} SELECT domain, kind, key, times FROM signals")
def host_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir)[0]


@_add("host_classes", f"""{_HOSTS}, {_PAIRS}, h AS (SELECT *, CASE WHEN kind = 'umami_src' THEN times ELSE 1 END AS w FROM o),
  l AS (SELECT a.kind, a.key, sum(CASE WHEN coalesce(a.cluster = b.cluster, false) THEN a.w * b.w ELSE 0 END) AS same, sum(CASE WHEN coalesce(a.cluster = b.cluster, false) THEN 0 ELSE a.w * b.w END) AS apart FROM h a JOIN h b ON a.kind = b.kind AND a.key = b.key AND a.ord < b.ord GROUP BY ALL)
  SELECT kind, key, type, count(*) AS n, arg_min(domain, ord) AS first, CAST(any_value(same) AS BIGINT) AS links_same, CAST(any_value(apart) AS BIGINT) AS links_cross, kind IN ({_KINDS}) AND key IN (SELECT key FROM wide) AS wide
  FROM o JOIN l USING (kind, key) JOIN r USING (kind) GROUP BY kind, key, type""")
def host_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes.key_classes(*_both(spark, sf_dir))


@_add("host_representatives", f"{_HOSTS}, {_PAIRS}, c AS (SELECT kind, key, arg_min(domain, ord) AS first FROM o JOIN r USING (kind) GROUP BY kind, key HAVING count(*) > 1) SELECT kind, key, first, domain FROM o JOIN c USING (kind, key) WHERE domain <> first")
def host_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes.representatives(*_both(spark, sf_dir))


@_add("host_findings", f"{_HOSTS}, {_PAIRS} SELECT * FROM pair")
def host_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.pair_findings(*_both(spark, sf_dir))


@_add("host_finding_counts", f"{_ALL} SELECT type, severity, count(*) AS n FROM allf GROUP BY ALL")
def host_finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes.finding_counts(*_both(spark, sf_dir))


@_add("host_severities", f"{_ALL} SELECT severity, CAST(count(*) AS BIGINT) AS n FROM allf GROUP BY ALL")
def host_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes.severity_counts(classes.finding_counts(*_both(spark, sf_dir)))


@_add("host_isolation", f"{_ALL}, {_ISOLATION}")
def host_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals, sites = _both(spark, sf_dir)
    return classes.isolation(classes.finding_counts(signals, sites), sites)


@_add("host_similarity", f"{_HOSTS}, {_PAIRS}, {_POINTS} SELECT a, b, similarity FROM points")
def host_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes.similarity(*_both(spark, sf_dir))


@_add("host_lookalikes", f"{_HOSTS}, {_PAIRS}, {_POINTS} SELECT a, b, similarity FROM points WHERE similarity >= 60")
def host_lookalikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts that are most likely run by the same people."""
    return classes.similarity(*_both(spark, sf_dir), least=60)


_COLUMNS = ", ".join(f"max(CASE WHEN j = {k} THEN s ELSE 0 END) AS c{k:02d}" for k in range(20))


@_add("host_matrix", f"""{_HOSTS}, {_PAIRS}, {_POINTS}, i AS (SELECT domain, row_number() OVER (ORDER BY ord) - 1 AS i FROM sites),
  both_ways AS (SELECT a, b, similarity FROM points UNION ALL SELECT b, a, similarity FROM points UNION ALL SELECT domain, domain, 100 FROM sites),
  cell AS (SELECT x.i // 20 AS row_block, y.i // 20 AS col_block, a AS domain, y.i % 20 AS j, similarity AS s FROM both_ways JOIN i x ON x.domain = a JOIN i y ON y.domain = b)
  SELECT CAST(row_block AS INTEGER) AS row_block, CAST(col_block AS INTEGER) AS col_block, domain, {_COLUMNS} FROM cell GROUP BY ALL""")
def host_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals, sites = _both(spark, sf_dir)
    return classes.matrix(classes.similarity(signals, sites), sites)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: which hosts look alike."""
    return host_similarity(spark, sf_dir)
