"""The first lines of each site's report, whatever the number of its findings.

Ranks are limited within tasks before the shuffle (Spark's window group limit), so that no task sees all lines of a site.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a site under its head.
LINES = 9


def brief(details: DataFrame, lines: int = LINES) -> DataFrame:
    """(domain, n, line): the first `lines` of each site's details (domain, place, line), or one less and how many more there are."""
    first = details.withColumn("n", F.row_number().over(Window.partitionBy("domain").orderBy("place", "line"))).where(F.col("n") <= lines)
    total = details.groupBy("domain").agg(F.count(F.lit(1)).alias("total"))
    rest = F.concat(F.lit("… +"), (F.col("total") - (lines - 1)).cast("string"), F.lit(" more"))
    cut = (F.col("total") > lines) & (F.col("n") == lines)
    return first.join(total, "domain").select("domain", "n", F.when(cut, rest).otherwise(F.col("line")).alias("line"))
