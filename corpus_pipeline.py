"""The training-data pipeline: quality, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the shared folder and read
again as the next stage's docs; all but the last return the columns of `documents`. Stages work on whatever columns docs has
beside doc_id, text and source, whatever their names; what they do with nulls, empty texts, ties and repeated rows is said in
their operators' modules; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import dedup, lines, mixing, packing
from tessera.llm import quality as discriminant
from tessera.llm.common import Scratch, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from sf_dir's labels."""
    return discriminant.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that an earlier document holds."""
    return lines.drop_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return dedup.drop_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.apply(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places: doc_id, piece, start, length, ids, sequence_id, offset."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mix), ("packing", pack)]

#: SQL can express neither the classifier nor the tokens; tests/llm compares each stage's rows with a plain version's.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as s:
        for name, stage in STAGES[:-1]:
            spent, docs = docs, s.write(stage(spark, docs, sf_dir), f"pipeline-{name}")
            s.drop(spent)
        return STAGES[-1][1](spark, docs, sf_dir)  # reads docs at once: its pieces are a written table
