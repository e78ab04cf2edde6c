"""Nearest neighbours by a block matrix join: int8 product tiles with error bounds, exact recomputation, heaps.

Queries and candidates are dealt into blocks by a hash of their id; a tile is a pair of blocks and one call of a Python
function. In a tile, unit vectors are rounded to int8 with a scale each. The product of the rounded vectors differs from
the cosine by at most what the rounding residuals' norms allow, so a candidate whose upper bound is below the K-th
largest lower bound met so far cannot be among the K nearest. The others' cosines are computed from the original vectors
in double precision and kept in a heap for each query; tiles' heaps are merged by a window over each query. The result
is exact, so its recall against brute force is 1.

Nulls and edges: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null
ids; vectors of another dimension than the query's are no candidates; rows that share an id count once (the first by
content); a query's own id is no candidate. Ties go to the smaller id. Extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 5
#: Every so many ids is a query.
EVERY = 50
#: Rows of a query block and of a candidate block, about; rows of the products computed at once.
QUERY_BLOCK, CANDIDATE_BLOCK, STRIP = 8192, 4096, 512


def _sum(x: np.ndarray) -> np.ndarray:
    """Row sums, added from left to right."""
    return np.cumsum(x, axis=1)[:, -1]


class _Block:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((*vectors.T[::-1], ids))
        ids, vectors = ids[order], vectors[order]
        first = np.concatenate([[True], ids[1:] != ids[:-1]])
        self.ids, self.x = ids[first], vectors[first]
        # Squares may leave the range of doubles; scaling by a power of two leaves the cosine as it is.
        self.x = np.ldexp(self.x, -np.frexp(np.abs(self.x).max(1))[1][:, None])
        self.norm = np.sqrt(_sum(self.x * self.x))
        unit = self.x / self.norm[:, None]
        self.scale = np.abs(unit).max(1) / 127
        self.codes = np.rint(unit / self.scale[:, None]).astype(np.int8)
        rounded = self.codes * self.scale[:, None]
        self.residual = np.sqrt(((unit - rounded) ** 2).sum(1))
        self.length = np.sqrt((rounded**2).sum(1))


def tile(queries: _Block, others: _Block, k: int) -> list[tuple[int, int, float]]:
    """The k nearest others of each query."""
    out = []
    wide = others.codes.astype(np.float32)  # products of int8 codes are exact in float32 up to 1040 dimensions
    if others.codes.shape[1] > 1000:
        wide = wide.astype(np.float64)
    for a in range(0, len(queries.ids), STRIP):
        rows = slice(a, a + STRIP)
        near = (queries.codes[rows].astype(wide.dtype) @ wide.T).astype(np.float64)
        near *= queries.scale[rows, None] * others.scale
        slack = queries.length[rows, None] * others.residual + queries.residual[rows, None] * (others.length + others.residual) + 1e-12
        own = queries.ids[rows, None] == others.ids
        low = np.where(own, -np.inf, near - slack)
        cut = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
        maybe = (near + slack >= cut[:, None]) & ~own
        for r, q in enumerate(range(a, min(a + STRIP, len(queries.ids)))):
            at = np.flatnonzero(maybe[r])
            if not len(at):
                continue
            score = _sum(others.x[at] * queries.x[q]) / (others.norm[at] * queries.norm[q])
            if len(at) > 4 * k:
                best = np.lexsort((others.ids[at], -score))[:k]
                at, score = at[best], score[best]
            heap: list[tuple[float, int]] = []
            for s, c in zip(score.tolist(), others.ids[at].tolist()):
                if len(heap) < k:
                    heapq.heappush(heap, (s, -c))
                else:
                    heapq.heappushpop(heap, (s, -c))
            out += [(int(queries.ids[q]), -c, s) for s, c in heap]
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)
    )


def search(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row whose id is divisible by `every`."""
    rows = usable(vectors).withColumns({"dim": F.size("v"), "hash": F.xxhash64("vec_id")})
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    n, q = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    across, down = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-q // QUERY_BLOCK))
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    queries = rows.where(is_query).select("vec_id", "v", "dim", F.pmod("hash", F.lit(down)).cast("int").alias("qb"), all_of(across).alias("cb"))
    others = rows.select("vec_id", "v", "dim", all_of(down).alias("qb"), F.pmod("hash", F.lit(across)).cast("int").alias("cb"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def block(t: pa.Table) -> _Block:
        ids = t.column("vec_id").to_numpy()
        return _Block(ids, t.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = tile(block(left), block(right), k) if left.num_rows and right.num_rows else []
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*found) if found else ([], [], []), schema)], schema=schema)

    keys = ["dim", "qb", "cb"]
    found = queries.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The same by comparing every query with every row.
SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM v),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    list_sum(list_transform(list_zip(c.v, q.v), lambda p: p[1] * p[2])) / (c.norm * q.norm) AS score
  FROM n q JOIN n c ON q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= {K}
"""
