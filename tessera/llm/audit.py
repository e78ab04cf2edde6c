"""What five document filters remove, alone and in every order, by part of the corpus.

Filters: A too few words, B too many repeated words, C too many capitals, D a listed character, E the text of a smaller id. The
first four look at one text. For E each text goes, under its xxhash, to the task that its hash names; there the texts of one hash
form a chain of (text, smallest id so far), compared in full, and each row whose id isn't the smallest of its text is reported.
Rows arrive sorted by hash (Spark's external sort), so one chain is held at a time. Before that shuffle each task keeps one copy
of equal texts, the one of the smallest id, and reports the others at once, so a text that a third of all rows hold travels once
for each task and `HELD_BYTES` of its texts, not once a row.

What remains of a document is its id, its part and a mask of the filters it fails. Masks with the labels' bits are counted in a
vector for each part, merged by combineByKey and written; all counts of all orders are sums over that vector. Before they are told,
the documents counted in each part are compared with a plain count of the table's rows, so that none can be lost on the way.

Null texts count as empty, and equal each other; a null part is the empty one. A null id is compared with none: its row never
fails E and makes no other row fail it. Rows with one id and one text are no copies of each other; each row counts. Of repeated
label rows of an id, a 1 wins. An empty table gives no rows. Columns beyond doc_id, text and source aren't read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby, permutations
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialize

LETTERS = "ABCDE"
#: Fewest words; least distinct words and most capitals, per cent; characters that may not occur.
WORDS, DISTINCT, CAPITALS, LISTED = 50, 65, 5, rb"[#$%&*|]"
#: Bits of a mask: failing A to E, a label of good quality, a label of toxicity.
BITS = {c: 1 << k for k, c in enumerate(LETTERS)}
COPY, GOOD, TOXIC, MASKS = BITS["E"], 32, 64, 128
#: Bytes of texts that a task holds before the shuffle.
HELD_BYTES = 32 << 20

_capitals = bytes(range(ord("A"), ord("Z") + 1))
_listed = re.compile(LISTED)

Row = tuple[object, str, int]  # id, part, mask


def text_mask(text: str) -> int:
    """Bits of the filters A to D that the text fails."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: at ASCII white space only
    fails = (
        len(words) < WORDS,
        100 * len(set(words)) < DISTINCT * len(words),
        100 * (len(raw) - len(raw.translate(None, _capitals))) > CAPITALS * len(text),
        _listed.search(raw) is not None,
    )
    return sum(bit for bit, fail in zip(BITS.values(), fails) if fail)


class Chain:
    """The texts of a hash, each with its smallest id and the rows that have that id."""

    def __init__(self) -> None:
        self.links: list[list] = []

    def add(self, text: str, doc_id: object, rows: Counter) -> Iterator[tuple[Row, int]]:
        """Takes rows of a text and an id; yields those known by now not to have the smallest one."""
        for link in self.links:
            if link[0] == text:
                if doc_id == link[1]:
                    link[2].update(rows)
                    return
                if doc_id < link[1]:
                    doc_id, rows, link[1], link[2] = link[1], link[2], doc_id, Counter(rows)
                for (part, mask), n in rows.items():
                    yield (doc_id, part, mask | COPY), n
                return
        self.links.append([text, doc_id, Counter(rows)])

    def firsts(self) -> Iterator[tuple[Row, int]]:
        for _, doc_id, rows in self.links:
            for (part, mask), n in rows.items():
                yield (doc_id, part, mask), n


def _combined(rows: Iterable) -> Iterator[tuple[int, tuple]]:
    """(hash, (text, id, rows)) once for each text held, and (hash, (None, row, n)) for what is decided."""
    held: dict[int, Chain] = {}
    size = 0
    for doc_id, part, text, key in rows:
        mask = text_mask(text)
        if doc_id is None:
            yield key, (None, (None, part, mask), 1)
            continue
        chain = held.get(key)
        if chain is None:
            chain = held[key] = Chain()
        links = len(chain.links)
        for row, n in chain.add(text, doc_id, Counter({(part, mask): 1})):
            yield key, (None, row, n)
        if len(chain.links) > links:
            size += len(text)
        if size >= HELD_BYTES:
            yield from _sent(held)
            held, size = {}, 0
    yield from _sent(held)


def _sent(held: dict[int, Chain]) -> Iterator[tuple[int, tuple]]:
    for key, chain in held.items():
        for text, doc_id, rows in chain.links:
            yield key, (text, doc_id, dict(rows))


def _decided(rows: Iterable[tuple[int, tuple]]) -> Iterator[tuple]:
    """(id, part, mask, n) of all rows, which come sorted by hash."""
    for _, same in groupby(rows, itemgetter(0)):
        chain = Chain()
        for _, (text, a, b) in same:
            found = [(a, b)] if text is None else chain.add(text, a, Counter(b))
            for row, n in found:
                yield *row, n
        for row, n in chain.firsts():
            yield *row, n


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask, n: how many rows of an id and a part fail just the filters in mask."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("key")).rdd
    tasks = max(rows.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_by_hash = rows.mapPartitions(_combined).repartitionAndSortWithinPartitions(tasks, lambda key: key)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("part", T.StringType()), T.StructField("mask", T.IntegerType()), T.StructField("n", T.LongType())])
    return spark.createDataFrame(sorted_by_hash.mapPartitions(_decided), schema, verifySchema=False).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))


def vectors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, counts): the number of documents for each mask with the labels' bits."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    mask = F.col("mask") + GOOD * F.coalesce("good", F.lit(0)) + TOXIC * F.coalesce("toxic", F.lit(0))
    rows = failures(docs).join(known, "doc_id", "left").select("part", mask.alias("mask"), "n").rdd

    def add(counts: np.ndarray, x: tuple[int, int]) -> np.ndarray:
        counts[x[0]] += x[1]
        return counts

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a += b
        return a

    merged = rows.map(lambda r: (r.part, (r.mask, r.n))).combineByKey(lambda x: add(np.zeros(MASKS, np.int64), x), add, merge).mapValues(np.ndarray.tolist)
    return docs.sparkSession.createDataFrame(merged, "part string, counts array<long>", verifySchema=False)


def check_whole(docs: DataFrame, counted: DataFrame) -> None:
    """Raises if the vectors don't hold each row of docs once."""
    there = docs.groupBy(F.coalesce("source", F.lit("")).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    held = counted.select("part", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("held"))
    odd = there.join(held, "part", "full").where("n IS NULL OR held IS NULL OR n <> held").take(1)
    if odd:
        raise RuntimeError(f"documents counted in {odd[0].part!r}: {odd[0].held} of {odd[0].n}")


def _sums() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """All (order, step), and for each measure which masks count there."""
    steps = [("".join(order), k) for order in permutations(LETTERS) for k in range(1, 6)]
    mask = np.arange(MASKS)
    before = np.array([sum(BITS[c] for c in order[: k - 1]) for order, k in steps])[:, None]
    own = np.array([BITS[order[k - 1]] for order, k in steps])[:, None]
    fails, gone = mask & own > 0, mask & before > 0
    removed = fails & ~gone
    masks = {
        "kept": mask & (before | own) == 0,
        "removed": removed,
        "redundant": fails & gone,
        "unique_fails": mask & (GOOD - 1) == own,
        "good_lost": removed & (mask & GOOD > 0),
        "toxic_lost": removed & (mask & TOXIC > 0),
    }
    return steps, {name: m.astype(np.int64) for name, m in masks.items()}


COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
STEPS, SUMS = _sums()
FILTERS = [order[k - 1] for order, k in STEPS]


def report(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """The rows of a part: each order, each step."""
    sums = {name: m @ counts for name, m in SUMS.items()}
    shapley: Counter = Counter()
    for letter, removed in zip(FILTERS, sums["removed"].tolist()):
        shapley[letter] += removed
    for k, (order, step) in enumerate(STEPS):
        yield part, order, step, *(int(sums[c][k]) for c in COLUMNS[:-1]), shapley[FILTERS[k]]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    counted = materialize(vectors(docs, labels), "audit-vectors")
    check_whole(docs, counted)
    rows = counted.rdd.flatMap(lambda x: report(x.part, np.array(x.counts, np.int64)))
    return docs.sparkSession.createDataFrame(rows, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COLUMNS), verifySchema=False)


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (CASE WHEN len(w) < 50 THEN 'A' ELSE '' END)
         || (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
         || (CASE WHEN least < doc_id THEN 'E' ELSE '' END) AS f
  FROM d LEFT JOIN known USING (doc_id)),
counted AS (SELECT part, f, good, toxic, count(*) AS n FROM fails GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
  SELECT a.c || b.c || x.c || y.c || z.c AS filter_order
  FROM letter a, letter b, letter x, letter y, letter z
  WHERE len(list_distinct([a.c, b.c, x.c, y.c, z.c])) = 5),
steps AS (SELECT filter_order, CAST(s AS INTEGER) AS step, filter_order[s] AS own, filter_order[1:s - 1] AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
told AS (
  SELECT part, filter_order, step, own, f, n, good, toxic, contains(f, own) AS hit, length(translate(f, before, '')) < length(f) AS gone FROM counted, steps),
summed AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN f = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN hit AND NOT gone THEN n * good ELSE 0 END) AS good_lost,
         sum(CASE WHEN hit AND NOT gone THEN n * toxic ELSE 0 END) AS toxic_lost
  FROM told GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM summed
"""
