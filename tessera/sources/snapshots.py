"""Reports and snapshots as JSON: written by tasks, read by the shape that a file has, and a store of snapshots that are compared.

A file holds an array of scans, `{scans, correlation}`, one scan, a correlation report (`{findings, domains}`), or any other object,
which counts as a scan. Files are read as VARIANT and dealt with by what they hold; what is no JSON is kept aside.

The store keeps a row a site, bucketed and sorted by its name, with a fingerprint of its facts: two snapshots are joined without a
shuffle, and sites of equal fingerprints go before their facts are looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import tables

FINDING = "type string, severity string, domains array<string>, detail string, evidence string"


@dataclass
class Loaded:
    scans: DataFrame
    findings: DataFrame
    #: (path, text) of what could not be read.
    bad: DataFrame


def _has(v: Column, *names: str) -> Column:
    out = F.lit(True)
    for name in names:
        out = out & F.try_variant_get(v, f"$.{name}", "variant").isNotNull()
    return out


def load(spark: SparkSession, path: str, lines: bool = False) -> Loaded:
    """Scans and findings of JSON files, of one document each, or with `lines` one in each line."""
    raw = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).where(F.trim("text") != "")
    parsed = raw.withColumn("v", F.try_parse_json("text"))
    v = F.col("v")
    kind = F.when(F.schema_of_variant(v).startswith("ARRAY"), "array").when(_has(v, "scans", "correlation"), "report").when(_has(v, "domain", "timestamp"), "scan").when(_has(v, "findings", "domains"), "correlation").otherwise("scan")
    shaped = parsed.where("v IS NOT NULL").withColumn("kind", kind)
    items = F.when(F.col("kind") == "array", F.try_variant_get(v, "$", "array<variant>")).when(F.col("kind") == "report", F.try_variant_get(v, "$.scans", "array<variant>")).when(F.col("kind") == "scan", F.array(v))
    scans = shaped.select(F.explode(items).alias("s")).select(F.from_json(F.to_json("s"), tables.SNAPSHOT).alias("s")).select("s.*")
    report = F.when(F.col("kind") == "report", F.try_variant_get(v, "$.correlation.findings", "array<variant>")).when(F.col("kind") == "correlation", F.try_variant_get(v, "$.findings", "array<variant>"))
    findings = shaped.select(F.explode(report).alias("f")).select(F.from_json(F.to_json("f"), FINDING).alias("f")).select("f.*")
    return Loaded(scans, findings, parsed.where("v IS NULL").select("path", "text"))


def write_report(path: str, findings: DataFrame, scans: DataFrame | None = None, most: int = 50_000) -> None:
    """A folder of JSON documents of the shape `{scans, correlation}`, one a line, each of at most about `most` scans or findings.

    Spark's committer puts the folder in place as a whole or not at all. findings: (type, severity, domains, detail, evidence).
    """
    deal = lambda df: df.groupBy(F.spark_partition_id().alias("p"), F.floor(F.monotonically_increasing_id() % (1 << 33) / most).alias("k"))
    whole = deal(findings).agg(F.collect_list(F.struct(*[F.col(c) for c in findings.columns])).alias("f"))
    rows = whole.select(F.to_json(F.struct(F.expr("cast(array() AS array<string>)").alias("scans"), F.struct(F.col("f").alias("findings"), F.expr("cast(array() AS array<string>)").alias("domains")).alias("correlation"))).alias("value"))
    if scans is not None:
        each = deal(scans).agg(F.collect_list(F.struct(*[F.col(c) for c in scans.columns])).alias("s"))
        none = F.struct(F.expr("cast(array() AS array<string>)").alias("findings"), F.expr("cast(array() AS array<string>)").alias("domains"))
        rows = rows.unionByName(each.select(F.to_json(F.struct(F.col("s").alias("scans"), none.alias("correlation"))).alias("value")))
    rows.write.text(path)


def save(facts: DataFrame, name: str, buckets: int = 16) -> DataFrame:
    """The stored snapshot (domain, fingerprint, facts) of facts (domain, kind, key): facts are a site's distinct `kind: key`, sorted.

    `name` names a table of the session's catalog, whose files lie in the shared folder.
    """
    rows = facts.where("key IS NOT NULL").groupBy("domain").agg(F.sort_array(F.collect_set(F.concat_ws(": ", "kind", "key"))).alias("facts"))
    rows = rows.select("domain", F.sha2(F.to_json("facts"), 256).alias("fingerprint"), "facts")
    where = f"{tables.shared_folder(facts.sparkSession)}/{name}"
    rows.repartition(buckets, "domain").write.bucketBy(buckets, "domain").sortBy("domain").option("path", where).mode("overwrite").saveAsTable(name)
    return facts.sparkSession.table(name)


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(domain, change, detail) between two stored snapshots: new-domain, removed-domain, added and removed facts."""
    a, b = before.select("domain", F.col("fingerprint").alias("fa"), F.col("facts").alias("a")), after.select("domain", F.col("fingerprint").alias("fb"), F.col("facts").alias("b"))
    both = a.join(b.hint("merge"), "domain", "full").where(~F.col("fa").eqNullSafe(F.col("fb")))
    told = lambda change, values: F.transform(values, lambda x: F.struct(F.lit(change).alias("change"), x.alias("detail")))
    one = lambda change: F.array(F.struct(F.lit(change).alias("change"), F.lit("").alias("detail")))
    changes = F.when(F.col("fa").isNull(), one("new-domain")).when(F.col("fb").isNull(), one("removed-domain")).otherwise(F.concat(told("added", F.array_except("b", "a")), told("removed", F.array_except("a", "b"))))
    return both.select("domain", F.explode(changes).alias("c")).select("domain", "c.change", "c.detail")
