"""robots.txt groups as window functions over exploded lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def robots_lines(files: DataFrame) -> DataFrame:
    """(domain, pos, key, value, grp) from (domain, body): consecutive user-agent lines begin a group, directives end its head."""
    lines = files.select("domain", F.posexplode(F.split("body", "\r?\n")).alias("pos", "raw"))
    bare = F.trim(F.regexp_replace("raw", "#.*$", ""))
    parsed = lines.select("domain", "pos", F.lower(F.regexp_extract(bare, r"^([A-Za-z-]+)\s*:", 1)).alias("key"), F.trim(F.regexp_extract(bare, r"^[A-Za-z-]+\s*:\s*(.*)$", 1)).alias("value"))
    parsed = parsed.where(F.col("key").isin("user-agent", "disallow", "allow", "crawl-delay"))
    order = Window.partitionBy("domain").orderBy("pos")
    agent = F.col("key") == "user-agent"
    begins = agent & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")
    return parsed.withColumn("grp", F.sum(begins.cast("int")).over(order))


def robots_summary(files: DataFrame) -> DataFrame:
    """domain, agents, blocked (first seen first, joined by |), blocks_all, paths (sorted, joined by |)."""
    lines = robots_lines(files)
    agent = F.col("key") == "user-agent"
    bars = lines.groupBy("domain", "grp").agg(F.max(((F.col("key") == "disallow") & (F.col("value") == "/")).cast("int")).alias("bars"))
    blocked = lines.where(agent).join(bars.where("bars = 1"), ["domain", "grp"]).groupBy("domain", "value").agg(F.min("pos").alias("pos"))
    blocked = blocked.groupBy("domain").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("b"))
    paths = lines.where((F.col("key") == "disallow") & ~F.col("value").isin("", "/"))
    paths = paths.groupBy("domain").agg(F.array_join(F.sort_array(F.collect_set("value")), "|").alias("paths"))
    counts = files.select("domain").join(lines.groupBy("domain").agg(F.sum(agent.cast("long")).alias("agents")), "domain", "left")
    out = counts.join(blocked, "domain", "left").join(paths, "domain", "left")
    names = F.coalesce(F.col("b.value"), F.array().cast("array<string>"))
    return out.select("domain", F.coalesce("agents", F.lit(0)).alias("agents"), F.array_join(names, "|").alias("blocked"), F.array_contains(names, "*").alias("blocks_all"), F.coalesce("paths", F.lit("")).alias("paths"))
