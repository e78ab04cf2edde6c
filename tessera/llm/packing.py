"""Best-fit packing of token sequences by exact-complement hashing.

Texts are tokenised and cut into pieces of at most `CAPACITY` tokens. What is packed is the histogram of piece lengths
(at most CAPACITY numbers, whatever the corpus): for each length, longest first, sums of one, two or three lengths that
fill the gap exactly are looked up under the counts left and consumed as often as they last; the rest goes best-fit,
longest first. Which sums go first matters, so the plan is made in a few ways and the one with the fewest bins is kept. The
plan is a list of bin patterns with multiplicities. Pieces are then ranked within their length by a
hash in blocks, and a rank's bin and offset follow from the plan, so no group of equal lengths meets in one task.

Nulls and edges: a null text is empty and packs as its end token alone; a null id is kept and hashes like 0; repeated
rows are packed each; an empty table gives an empty result. Extra columns are not carried.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.common import materialize

CAPACITY = 4096
#: Put after each document's ids.
END = 1
BLOCKS = 1024
#: Texts are tokenised in groups of about so many characters, which bounds a worker's memory.
GROUP_CHARS = 8_000_000

#: Ways to look up complements: all sums for each length at once, or single lengths first, then also pairs, then also triples.
WAYS = (((1, 2, 3),), ((1,),), ((1,), (2,)), ((1,), (2,), (3,)))

Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, times), ...), bins


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Bin patterns for so many pieces of each length: the fewest of what the ways to look complements up lead to."""
    return min((_plan(counts, capacity, sums) for sums in WAYS), key=lambda patterns: sum(times for _, times in patterns))


def _plan(counts: dict[int, int], capacity: int, sums: tuple[tuple[int, ...], ...]) -> list[Pattern]:
    """Bin patterns if each of sums, in turn, says of how many lengths complements may be."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    out: list[Pattern] = []

    def take(lengths: list[int]) -> None:
        need = Counter(lengths)
        times = min(int(left[x]) // k for x, k in need.items())
        for x, k in need.items():
            left[x] -= times * k
        out.append((tuple(sorted(need.items(), reverse=True)), times))

    def pair(total: int) -> list[int]:
        """Two lengths left that sum to total, the larger one as large as can be."""
        half = total // 2
        small = np.arange(1, half + 1)
        found = (left[small] > 0) & (left[total - small] > 0)
        if total % 2 == 0 and half:
            found[-1] = left[half] > 1
        k = int(found.argmax()) if len(found) else 0
        return [total - k - 1, k + 1] if len(found) and found[k] else []

    def complement(length: int, allowed: tuple[int, ...]) -> list[int]:
        """Lengths that fill what `length` leaves of a bin, so many as are allowed, [] if none do."""
        gap = capacity - length
        if 1 in allowed and gap and left[gap] > 0:
            return [gap]
        if 2 in allowed and (two := pair(gap)):
            return two
        for first in np.flatnonzero(left[: gap - 1])[::-1].tolist() if 3 in allowed and gap > 2 else []:
            if first * 3 < gap:
                break
            left[first] -= 1
            two = pair(gap - first)
            left[first] += 1
            if two:
                return [first, *two]
        return []

    if left[capacity]:
        take([capacity])
    for allowed in sums:
        for length in range(capacity - 1, 0, -1):
            while left[length] > 0:
                left[length] -= 1
                rest = complement(length, allowed)
                left[length] += 1
                if not rest:
                    break
                take([length, *rest])
    # Best fit, longest first, over groups of equal bins: gap -> [contents, number of bins].
    bins: dict[int, list] = defaultdict(list)
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            gap = min((g for g in bins if g >= length), default=None)
            if gap is None:
                each = capacity // length
                full, over = divmod(n, each)
                for inside, times in ((each, full), (over, 1)):
                    if inside and times:
                        bins[capacity - inside * length].append([Counter({length: inside}), times])
                n = 0
                continue
            inside, times = bins[gap].pop()
            if not bins[gap]:
                del bins[gap]
            each = min(gap // length, -(-n // times)) if n >= times else 1
            used = min(times, n // each)
            if used < times:
                bins[gap].append([inside, times - used])
            bins[gap - each * length].append([inside + Counter({length: each}), used])
            n -= used * each
    out += [(tuple(sorted(inside.items(), reverse=True)), times) for groups in bins.values() for inside, times in groups]
    return [p for p in out if p[1]]


def slots(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, sequence of the first rank, pieces in each bin, offset), sorted by length and rank."""
    rows, next_rank, sequence = [], Counter(), 0
    for inside, times in patterns:
        offset = 0
        for length, each in inside:
            rows.append((length, next_rank[length], sequence, each, offset))
            next_rank[length] += each * times
            offset += each * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def tokenise(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids (little-endian uint32)."""
    path = vocabulary or tokens.default_vocabulary()

    def cut(batches: Iterator[pa.RecordBatch], bpe: tokens.WordBpe, end: bytes, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            k = 0
            while k < len(texts):
                some, chars, first = [], 0, k
                while k < len(texts) and (chars < GROUP_CHARS or not some):
                    some.append(texts[k].as_py() or "")
                    chars += len(some[-1])
                    k += 1
                cols: list[list] = [[], [], [], [], []]
                for doc, raw in zip(ids.slice(first, len(some)).to_pylist(), bpe.encode(some)):
                    raw += end
                    total = len(raw) // 4
                    for piece, start in enumerate(range(0, total, capacity)):
                        part = raw[4 * start : 4 * (start + capacity)] if total > capacity else raw
                        for col, value in zip(cols, (doc, piece, start, len(part) // 4, part)):
                            col.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc

        bpe = tokens.load(path)
        end = np.array([END], "<u4").tobytes()
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
        gc.disable()  # the word tables hold no cycles
        try:
            yield from cut(batches, bpe, end, schema)
        finally:
            gc.enable()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids binary")


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset; they must not change when read again (a written table)."""
    named = pieces.withColumn("__hash", F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0)), "piece"))
    named = named.withColumn("__block", F.pmod("__hash", F.lit(BLOCKS)).cast("int"))
    blocks = materialize(named.groupBy("length", "__block").agg(F.count(F.lit(1)).alias("n")), "pack-blocks")
    # At most `capacity` rows reach the driver, and the plan made of them is a table of lengths too.
    counts = {r["length"]: r["n"] for r in blocks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("length", "__block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("length", "__block").orderBy("__hash", "doc_id", "piece")
    ranked = named.join(blocks, ["length", "__block"]).withColumn("__rank", (F.row_number().over(within) - 1 + F.col("__before")).cast("long"))
    columns = [*pieces.columns, "__rank"]
    schema = ranked.select(*columns).schema.add("sequence_id", "long").add("offset", "long")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("__rank").to_numpy()
            at = np.searchsorted(keys, length << 48 | rank, side="right") - 1
            _, first, sequence, each, offset = table[at].T if len(at) else np.zeros((5, 0), np.int64)
            bin_, inside = np.divmod(rank - first, np.maximum(each, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence + bin_), pa.array(offset + inside * length)], names=[*batch.schema.names, "sequence_id", "offset"])

    return ranked.select(*columns).mapInArrow(assign, schema).drop("__rank")


def pack(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Pieces with their ids and places."""
    return place(materialize(tokenise(docs, vocabulary), "pack-pieces"))


def digest(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = tokenise(docs, vocabulary).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return place(materialize(pieces, "pack-pieces"))
