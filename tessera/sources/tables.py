"""Inputs: page tables, snapshots and small fleets."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOST = "^https?://([^/:?#]+)"

#: A scan record as it is stored; sub-records that a scan left out are null.
SNAPSHOT = """
domain string, timestamp string, isNoindex boolean,
http struct<statusCode:int, headers:map<string,string>, serverHeader:string, setCookies:array<string>>,
dns struct<a:array<string>, ns:array<string>, txt:array<string>, cname:array<string>, mx:array<struct<exchange:string,priority:int>>, spf:struct<includes:array<string>,ip4:array<string>,ip6:array<string>,redirect:string>, dmarc:struct<rua:array<string>,ruf:array<string>>, caa:array<string>, googleVerification:string, microsoftVerification:string, facebookVerification:string>,
tls struct<issuer:string, san:array<string>>, whois struct<registrar:string, registrantOrg:string, createdDate:string>,
html struct<headStructureHash:string, bodyStructureHash:string, metaGenerator:string, inlineScriptHashes:array<string>, comments:array<string>, emails:array<string>, formEndpoints:array<string>, twitterCards:map<string,string>, jsonLd:array<struct<sameAs:array<string>>>>,
assets struct<faviconHash:string, cssHashes:array<struct<url:string,hash:string>>, jsHashes:array<struct<url:string,hash:string>>, fontSources:array<string>>,
robots struct<robotsTxtHash:string, adsTxtHash:string, adsTxtPubIds:array<string>, sitemapUrls:array<string>, sitemapHash:string, affiliateRedirectPaths:array<string>, securityTxtContacts:array<string>>,
analytics struct<ga4:array<string>, gtm:array<string>, adsense:array<string>, facebook:array<string>, clarity:array<string>, cloudflare:array<string>, plausible:array<string>, umami:array<struct<websiteId:string,src:string>>, other:array<struct<name:string,id:string>>>,
content struct<isAdult:boolean, adultScore:int>, security struct<score:int, reportEndpoints:array<string>, formProviders:array<string>>, seo struct<score:int>, errors array<struct<scanner:string,error:string>>
"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, host, html)."""
    found = spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", F.regexp_extract("url", HOST, 1).alias("host"), F.coalesce("html", F.lit("")).alias("html"))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if its partitions would keep them busy a quarter longer than even ones: pages cost far more than their shuffle.

    Rows are counted, not partitions: files are cut by bytes, and a part without the start of a row group holds none.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.groupBy(F.spark_partition_id().alias("part")).count().agg(F.count(F.lit(1)).alias("n"), F.max("count").alias("most"), F.sum("count").alias("rows")).first()
    waves = -(-parts["n"] // cores)
    return df.repartition(4 * cores) if parts["n"] and 4 * waves * cores * parts["most"] > 5 * parts["rows"] else df


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Scan records of a JSON file: an array of scans, one scan, or an object with `scans`. The schema is given, not inferred."""
    wrapped = spark.read.schema(f"scans array<struct<{_fields()}>>, {SNAPSHOT}").json(path, multiLine=True)
    inner = wrapped.where("scans IS NOT NULL").select(F.explode("scans").alias("s")).select("s.*")
    return wrapped.where("scans IS NULL AND domain IS NOT NULL").drop("scans").unionByName(inner)


def _fields() -> str:
    from pyspark.sql.types import StructType

    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(SNAPSHOT).fields)


def fleet_yaml(text: str) -> dict[str, object]:
    """The keys of a small fleet file, with flow or block lists; text after # is left out."""
    out: dict[str, object] = {}
    key = None
    for raw in text.splitlines():
        line = raw.split("#", 1)[0].rstrip()
        if line.lstrip().startswith("- ") and key:
            held = out.setdefault(key, [])
            if isinstance(held, list):
                held.append(line.strip()[2:].strip().strip("\"'"))
        elif ":" in line:
            key, value = (x.strip() for x in line.split(":", 1))
            if value.startswith("["):
                out[key] = [x.strip().strip("\"'") for x in value.strip("[]").split(",") if x.strip()]
            elif value:
                out[key] = value.strip("\"'")
            else:
                out[key] = []
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share; where that is unset, a temporary one, in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        where = context._jsc.sc().getCheckpointDir().get()
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read from there: computed once however often it is used, and not again if an executor is lost."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
