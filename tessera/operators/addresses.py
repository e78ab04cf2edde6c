"""Addresses in texts and the ranges that hold them: a join by prefixes, the longest one wins.

An address is a letter for its family and its bits; a range is the first bits of all its addresses. An address is exploded into its
prefixes, which makes "lies in a range" an equi-join whatever the number of ranges, and ranges may hold each other. Addresses of
one text are looked up once, those of many texts once for all. IPv4 addresses written as IPv6 ones count as IPv4.

Null texts and texts without addresses give no rows; what isn't an address is null to `bits` and in no range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import records
from tessera.functions.markup import let
from tessera.registry import ADDRESS_RANGES

#: Runs of letters that addresses are made of; a full stop behind one ends a sentence.
TOKEN, HINT = "[0-9A-Za-z_:.]+", "[0-9][.][0-9]|:[0-9A-Fa-f]*:"


def bits(ip: Column) -> Column:
    """The family (4 or 6) and the bits of an address, null for anything else."""
    octets = F.transform(F.split(ip, r"\."), lambda x: F.lpad(F.bin(x.cast("long")), 8, "0"))

    def six(groups: Column) -> Column:
        wide = F.array_join(F.transform(groups, lambda x: F.lpad(F.bin(x.cast("long")), 16, "0")), "")
        return let(wide, lambda w: F.when(F.substring(w, 1, 96) == "0" * 80 + "1" * 16, F.concat(F.lit("4"), F.substring(w, 97, 32))).otherwise(F.concat(F.lit("6"), w)))

    return F.when(ip.rlike(f"^{records.V4}$"), F.concat(F.lit("4"), F.array_join(octets, ""))).when(ip.contains(":"), let(records.groups(ip), six))


def prefix(cidr: Column) -> Column:
    """The family and the first bits of a range; null if it is none."""
    size = F.substring_index(cidr, "/", -1).try_cast("int")
    return let(bits(F.substring_index(cidr, "/", 1)), lambda own: F.when(size.between(0, F.length(own) - 1), F.substring(own, F.lit(1), size + 1)))


def found(text: Column) -> Column:
    """The distinct addresses in a text, as they are written."""
    tokens = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda x: F.rtrim(x, F.lit(".")))
    some = F.filter(F.array_distinct(F.filter(tokens, lambda x: x.rlike(HINT))), lambda x: bits(x).isNotNull())
    return F.when(text.rlike(HINT), some).otherwise(F.array().cast("array<string>"))


def ranges(spark, rows: tuple[tuple[str, str], ...] = ADDRESS_RANGES) -> DataFrame:
    """(cidr, name)."""
    return spark.createDataFrame(list(rows), "cidr string, name string")


def classed(addresses: DataFrame, ranges: DataFrame) -> DataFrame:
    """(ip, cidr, name) of the distinct addresses (ip): the smallest range that holds each; null for an address in none."""
    own = addresses.select("ip").distinct().withColumn("bits", bits(F.col("ip"))).where("bits IS NOT NULL")
    each = own.select("ip", F.explode(F.transform(F.sequence(F.lit(1), F.length("bits")), lambda n: F.substring(F.col("bits"), F.lit(1), n))).alias("prefix"))
    known = ranges.select("cidr", "name", prefix(F.col("cidr")).alias("prefix")).where("prefix IS NOT NULL")
    met = each.join(known, "prefix").groupBy("ip").agg(F.max_by(F.struct("cidr", "name"), F.struct(F.length("prefix"), "cidr")).alias("r"))
    return own.select("ip").join(met, "ip", "left").select("ip", "r.cidr", "r.name")


def in_texts(texts: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """(key, ip, cidr, name): the distinct addresses of each text (key, text), and their ranges."""
    each = texts.select(key, F.explode(found(F.col("text"))).alias("ip")).distinct()
    return each.join(classed(each, ranges), "ip").select(key, "ip", "cidr", "name")
