"""Collocations: phrases of a language whose words occur together more often than their parts let expect.

All phrases of 1 to max_n words of all pieces of all texts become rows: a task reads some megabytes of a language at a time, numbers
the words, and numbers each longer phrase as a pair of the number of its beginning and that of its last word, so that sorting numbers
explodes and counts them; it puts out a row (language, phrase, occurrences there) for each distinct one. Spark deals these rows out
by language and phrase and adds them up in a hash aggregation. Of its result the phrases with `least` occurrences or more are written once, with the number of all other words of
each language; what follows reads that table. A candidate has two words or more. It goes if some phrase of one more word holds it
and has `share` per cent of its occurrences (a longer one that does has a part of one more word that does too), found by an
anti-join on the longer candidates without their first or last word. Each cut of those left is joined with the counts of its two
parts, which occur at least as often as the whole, so they are in the table; a * a * 1000000 / (l * r) is computed in decimals of 38
digits, exact up to 10**15 occurrences, and floored. The first `top` of a language are found by ranking within hashed shares of it
first, so that no task sorts all candidates of a language.

Null texts count as empty and give no row; a null language is `und`. Words hold whatever isn't a space or a tab; pieces end at
.,;:!? and at the characters 10 to 13. Repeated rows count again. An empty table gives no rows. Columns beyond text and lang
aren't read. Long texts are read in parts; the words before a part are kept for the phrases that cross its begin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import LOWER, UPPER, Scratch

#: Bytes that end a piece, and a byte that no text holds, which stands for them.
ENDS, END = b".,;:!?\n\x0b\x0c\r", b"\xff"
FOLD = bytes.maketrans(UPPER.encode() + ENDS + b"\t", LOWER.encode() + END * len(ENDS) + b" ")
#: Bytes of text whose phrases a task holds at once, and rows that it hands over at once.
PART_BYTES, BATCH_ROWS = 16 << 20, 100_000
#: Most words of a phrase, least occurrences, per cent of occurrences at which a longer phrase replaces one, rows of a language.
MAX_N, LEAST, SHARE, TOP = 3, 10, 50, 2000
#: Shares of a language that are ranked on their own first.
SHARES = 64


def parts(data: bytes, size: int) -> Iterator[bytes]:
    """data in parts of about `size` bytes, cut behind a blank or an end; a longer word stays whole."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            cut = max(data.rfind(b" ", at, end), data.rfind(END, at, end)) + 1
            while cut <= at and end < len(data):  # a word longer than the part
                end += size
                cut = max(data.rfind(b" ", at, end), data.rfind(END, at, end)) + 1
            end = cut if cut > at else len(data)
        yield data[at:end]
        at = end


def _tokens(part: bytes) -> pa.Array:
    """The words and ends of a part, in one buffer: as objects of their own they would take ten times their letters."""
    found = pc.split_pattern(pa.array([part.replace(END, b" \xff ")], pa.binary()), " ").flatten()
    return found.filter(pc.greater(pc.binary_length(found), 0))


def phrases_of(data: bytes, max_n: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Distinct phrases of 1 to max_n words of folded text, and how often each occurs; a phrase may come again for another part."""
    before: list[bytes] = []  # the last words of what was read
    for part in parts(data, PART_BYTES):
        tokens = pa.concat_arrays([pa.array(before, pa.binary()), _tokens(part)])
        known = len(before)
        before = tokens[max(0, len(tokens) - max_n + 1) :].to_pylist()
        coded = tokens.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()  # words by their bytes, so that phrases come out in order
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        words, code = coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()]
        del tokens, coded
        width = len(words)
        ends = len(words) - 1 if width and words[width - 1].as_py() == END else -1
        is_end = code == ends
        # Of the phrases of n words, by their last word's place: whether there is one, and its number among the distinct ones.
        there, number, names = ~is_end, code, words
        for n in range(1, max_n + 1):
            if n > 1:
                there = np.concatenate(([False], there[:-1])) & ~is_end
                number = np.concatenate(([0], number[:-1])) * width + code
            new = there.copy()
            new[:known] = False
            if n < max_n:
                found, inverse, times = np.unique(number[there], return_inverse=True, return_counts=True)
                if known:
                    times = times - np.bincount(inverse[: np.count_nonzero(there[:known])], minlength=len(found))
            else:
                found, times = np.unique(number[new], return_counts=True)
            if n > 1:
                names = pc.binary_join_element_wise(names.take(pa.array(found // width)), words.take(pa.array(found % width)), b" ")
            else:
                names = words.take(pa.array(found))
            some = times > 0
            if len(found):
                yield (names, times) if some.all() else (names.filter(pa.array(some)), times[some])
            if n < max_n:
                number = np.zeros(len(code), np.int64)
                number[there] = inverse


def _gathered(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """Each language's texts, folded, with ends between them: PART_BYTES at a time, or one longer text."""
    held: dict[str, tuple[list[bytes], int]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        some, size = held.get(lang, ([], 0))
        raw = text.as_buffer()
        if some and size + len(raw) > PART_BYTES:
            yield lang, END.join(some).translate(FOLD)
            some, size = [], 0
        some.append(raw.to_pybytes())
        held[lang] = some, size + len(raw)
    for lang, (some, _) in held.items():
        yield lang, END.join(some).translate(FOLD)


def grams(docs: DataFrame, max_n: int = MAX_N) -> DataFrame:
    """key and n: the phrases of 1 to max_n words of all pieces, a row for each distinct one of each part of a task's texts.

    key is the phrase, a tab and the language: one column, as these rows are most of what is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, data in _gathered(batch):
                for names, times in phrases_of(data, max_n):
                    for k in range(0, len(names), BATCH_ROWS):
                        keys = pc.binary_join_element_wise(names.slice(k, BATCH_ROWS).cast(pa.string()), lang, "\t")
                        yield pa.RecordBatch.from_arrays([keys, pa.array(times[k : k + BATCH_ROWS], pa.int64())], ["key", "n"])

    slim = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text IS NOT NULL")
    return slim.mapInArrow(run, "key string, n long")


def counts(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST) -> DataFrame:
    """lang, phrase, f of all phrases that occur `least` times or more; with a null phrase, the number of all rarer single words."""
    # The tasks have counted already; counting once more before the shuffle would only fill their memory. There is more of them than of the texts.
    tasks = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    f = grams(docs, max_n).repartition(tasks, "key").groupBy("key").agg(F.sum("n").alias("f"))
    phrase = F.substring_index("key", "\t", 1)
    f = f.where((F.col("f") >= least) | ~F.contains(phrase, F.lit(" "))).select(phrase.alias("phrase"), "key", "f")
    f = f.select(F.expr("substring(key, char_length(phrase) + 2)").alias("lang"), F.when(F.col("f") >= least, F.col("phrase")).alias("phrase"), "f")
    return f.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _words(phrase: Column) -> Column:
    return F.regexp_count(phrase, F.lit(" ")) + 1


def maximal(candidates: DataFrame, share: int = SHARE) -> DataFrame:
    """Candidates (lang, phrase, a) that no longer one replaces."""
    p = F.col("phrase")
    longer = candidates.where(_words(p) > 2).withColumn("part", F.explode(F.array(F.expr("substring(phrase, instr(phrase, ' ') + 1)"), F.expr("substring(phrase, 1, char_length(phrase) - char_length(substring_index(phrase, ' ', -1)) - 1)"))))
    most = longer.groupBy(F.col("lang").alias("lang_"), F.col("part").alias("phrase_")).agg(F.max("a").alias("most"))
    return candidates.join(most, F.expr(f"lang = lang_ AND phrase = phrase_ AND 100 * most >= {share} * a"), "left_anti")


def scored(candidates: DataFrame, f: DataFrame) -> DataFrame:
    """Candidates with l, r and score of their lowest cut, ties to the first."""
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), _words(F.col("phrase")) - 1)))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring(phrase, char_length(left) + 2)"))
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(f.select("lang", F.col("phrase").alias(side), F.col("f").alias(count)), ["lang", side])
    exact = {c: F.col(c).cast("decimal(18,0)") for c in "alr"}
    cuts = cuts.withColumns({"above": exact["a"] * exact["a"] * F.lit(1_000_000).cast("decimal(38,0)"), "below": exact["l"] * exact["r"]})
    lowest = F.min(F.struct(F.expr("above div below").alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), lowest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def ranked(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` of each language with their ranks."""
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    first = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    some = phrases.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).withColumn("rank", first).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("part")


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    with Scratch(docs.sparkSession) as s:
        f = s.write(counts(docs, max_n, least), "phrase-counts")
        single = F.col("phrase").isNull() | ~F.contains("phrase", F.lit(" "))
        n = f.where(single).groupBy("lang").agg(F.sum("f").alias("n"))
        candidates = f.where(F.contains("phrase", F.lit(" "))).withColumnRenamed("f", "a")
        found = ranked(scored(maximal(candidates, share), f.where("phrase IS NOT NULL")), top)
        return s.out(found.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases")


SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
f AS (
  SELECT lang, size, phrase, count(*) AS f FROM (
    SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
    FROM words, (SELECT unnest([1, 2, 3]) AS size) WHERE len(w) >= size)
  GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
candidate AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
maximal AS (
  SELECT * FROM candidate c WHERE NOT EXISTS (
    SELECT 1 FROM candidate d WHERE d.lang = c.lang AND c.size = 2 AND d.size = 3 AND 100 * d.a >= 50 * c.a AND (d.w[1:2] = c.w OR d.w[2:3] = c.w))),
cut AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM maximal c JOIN (SELECT unnest([1, 2]) AS k) ON k < size
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')),
lowest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
place AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM place JOIN total USING (lang) WHERE rank <= 2000
"""
