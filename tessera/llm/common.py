"""What the training-data operators share: word rules, intermediate tables, label splits."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII white-space characters.
WORD = "[^\\x20\\x09-\\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a temporary one, but in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        where = jsc.getCheckpointDir().get()
    return where.rstrip("/")


class Scratch:
    """Written intermediate tables in the shared folder. Lineage ends at each: a lost executor loses nothing.

    Parquet rather than RDD checkpoints, so that later readers prune columns and Spark knows the size. Tables written by
    `write` are deleted by `drop`, or all at the end of the `with` block; those written by `out` stay, for results that
    are still to be read.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._held: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop(*[df for df, _ in self._held.values()])

    def write(self, df: DataFrame, label: str) -> DataFrame:
        table, path = _written(df, label)
        self._held[id(table)] = table, path
        return table

    def out(self, df: DataFrame, label: str) -> DataFrame:
        return _written(df, label)[0]

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            if id(df) in self._held:
                _, path = self._held.pop(id(df))
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def _written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read back; the table stays."""
    return _written(df, label)[0]


def free_name(base: str, *frames: DataFrame) -> str:
    """A column name that none of frames has, in any case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out. Null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 2


def training_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label 0/1), one row an id: rows outside the held-out fold with a 0/1 label; of repeated rows, the largest label."""
    return (
        labels.where(~held_out(F.col("doc_id")) & F.col(column).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(column).cast("int").alias("label"))
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def starts(lengths: Column, block: int = 256) -> Column:
    """For each of an array's numbers the sum of all before it: summed within blocks, from the sums of the blocks."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    none = F.array().cast("array<int>")

    def within(n: Column, at: Column, begin: Column) -> Column:
        zero = F.struct(begin.alias("t"), none.alias("out"))
        return F.aggregate(F.slice(n, at + 1, F.lit(block)), zero, lambda a, x: F.struct((a["t"] + x).alias("t"), F.array_append(a["out"], a["t"]).alias("out")), lambda a: a["out"])

    def blocks(n: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(n) - 1, F.lit(block))
        sums = F.transform(at, lambda x: total(F.slice(n, x + 1, F.lit(block))))
        begins = let(sums, lambda x: F.transform(x, lambda _, i: total(F.slice(x, F.lit(1), i))))
        return F.flatten(F.transform(F.arrays_zip(at.alias("at"), begins.alias("t")), lambda z: within(n, z["at"], z["t"])))

    return let(lengths, lambda n: F.when(F.size(n) > block, blocks(n)).when(F.size(n) > 0, within(n, F.lit(0), F.lit(0))).otherwise(none))
