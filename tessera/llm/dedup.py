"""MinHash near-dedup: SuperMinHash signatures, banding, verification on whole sets, union-find grouping.

Documents with equal shingle sets are one node, named by its smallest doc_id; sets count as equal if a digest of 128 bits does that
is made of two independent hashes of 64 bits of each shingle. Nodes that share a band are candidates.
In each band's bucket all nodes are first compared with the smallest one, their pivot, and the links found are grouped.
What is left are buckets of several groups: there each node outside of the bucket's main group is compared with every node
that it isn't grouped with yet. Both steps deal nodes with their texts to cells of bounded size, a row for each node and
cell, and compare within the cell; pairs are never rows. A cell's links go through a union-find, so that nodes already
joined aren't compared again, and only links that join something leave it.

Candidates whose signatures agree in too few places are dropped (five standard errors below the threshold); the others are
confirmed on their full sets, under the second family of hashes. With 32 bands of 4 values, a pair at the threshold shares no band with a probability below 6e-6.

Nulls and edges: a null or wordless text has an empty set and is linked with nothing; rows without an id are linked by
equal sets only and have their class's smallest id (null if none has one); rows that share an id are one document, but
in `drop_copies` one for each of their texts; an empty table gives an empty result. Extra columns are ignored or, in
`drop_copies`, kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import shingles, tokens
from tessera.llm.common import Scratch, free_name
from tessera.llm.components import components

#: Places of two signatures that must agree: 0.75 of them less five standard errors.
AGREE = 71
#: Bytes of texts that are hashed at once; arrays of some forty times as many are made of them.
GROUP_BYTES = 1_000_000
#: Bytes of text on either side of a cell, about; more are dealt to more cells, in which all sides meet.
CELL_BYTES = 8_000_000
#: Nodes of a cell's left side that are compared at once.
STRIP = 128


def _groups(texts, size: int = GROUP_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Lower-cased texts in groups of about so many bytes, with the number of the first."""
    first, some, total = 0, [], 0
    for k, t in enumerate(texts):
        some.append(shingles.lowered(t.as_py()))
        total += len(some[-1])
        if total >= size:
            yield first, some
            first, some, total = k + 1, [], 0
    if some:
        yield first, some


def _nodes(texts: list[bytes], hashes: np.ndarray, bounds: np.ndarray) -> tuple[list[np.ndarray], list[bytes]]:
    """The sorted set of each text, and 128 bits that stand for it: of the set and of the sum of its shingles' second hashes."""
    second, _ = shingles.shingle_hashes(texts, 1)
    sets, digests = [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        one, at = np.unique(hashes[a:b], return_index=True)
        sets.append(one)
        digests.append(hashlib.blake2b(one.tobytes() + second[a:b][at].sum(dtype=np.uint64).tobytes(), digest_size=16).digest())
    return sets, digests


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, node, sig, bands): node is a digest of the set; sig holds the low byte of each place."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("sig", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in batches:
            for first, texts in _groups(batch.column(1)):
                hashes, bounds = shingles.shingle_hashes(texts)
                sets, digests = _nodes(texts, hashes, bounds)
                sig = shingles.superminhash(np.concatenate([*sets, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64))
                low = np.ascontiguousarray((shingles.mix(sig) & np.uint64(255)).astype(np.uint8)).view(np.int64)
                keys = shingles.band_keys(sig)
                cols = [batch.column(0).slice(first, len(texts)), [len(s) for s in sets], digests, list(low), list(keys)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
        pa.default_memory_pool().release_unused()  # workers outlive their tasks

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_shingles long, node binary, sig array<long>, bands array<long>")


def _agreeing(a: Column, b: Column) -> Column:
    """Places at which two signatures agree: each byte of the exclusive or is folded into its lowest bit."""
    differ = None
    for k in range(shingles.PLACES // 8):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        n = F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
        differ = n if differ is None else differ + n
    return F.lit(shingles.PLACES) - differ


class _Side:
    """One side of a cell."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.groups: list[int] = []
        self.sigs: list[np.ndarray] = []
        self.texts: list[str] = []

    def add(self, ids: np.ndarray, groups: np.ndarray, sigs: np.ndarray, texts: list[str]) -> None:
        self.ids += ids.tolist()
        self.groups += groups.tolist()
        self.sigs.append(sigs)
        self.texts += texts


def _links(left: _Side, right: _Side) -> list[tuple[int, int]]:
    """Links between the two sides that join groups which weren't joined before."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    sig_l, sig_r = np.concatenate(left.sigs), np.concatenate(right.sigs)
    known: dict[str, np.ndarray] = {}

    def sets(texts: list[str]) -> list[np.ndarray]:
        new = [t for t in dict.fromkeys(texts) if t not in known]
        for first, some in _groups([pa.scalar(t, pa.large_string()) for t in new]):
            for t, s in zip(new[first : first + len(some)], shingles.distinct(*shingles.shingle_hashes(some, 1))):
                known[t] = s
        return [known[t] for t in texts]

    out = []
    groups_r = np.array(right.groups)
    for a in range(0, len(left.ids), STRIP):
        rows = range(a, min(a + STRIP, len(left.ids)))
        near = np.array([((sig_r == sig_l[k]).sum(1) >= AGREE) & (groups_r != left.groups[k]) for k in rows])
        some = np.flatnonzero(near.any(1))
        others = np.flatnonzero(near.any(0))
        if not len(some):
            continue
        ours, theirs = sets([left.texts[a + k] for k in some]), sets([right.texts[k] for k in others])
        linked = shingles.linked(ours, theirs) & near[np.ix_(some, others)]
        for i, j in zip(*np.nonzero(linked)):
            u, v = a + some[i], others[j]
            x, y = find(left.groups[u]), find(right.groups[v])
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((left.ids[u], right.ids[v]))
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the cells in rows (key, a, b, side, id, group, sig, text), sorted by cell; a cell may span batches."""
    cell, sides = None, (_Side(), _Side())

    def done() -> pa.RecordBatch:
        links = _links(*sides) if all(s.ids for s in sides) else []
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, a, b, side, ids, groups = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
        sig = batch.column("sig").flatten().to_numpy().reshape(batch.num_rows, -1).view(np.uint8)
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (side[1:] != side[:-1])) + 1
        for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            now = key[x], a[x], b[x]
            if now != cell:
                if cell is not None:
                    yield done()
                cell, sides = now, (_Side(), _Side())
            sides[side[x]].add(ids[x:y], groups[x:y], sig[x:y], batch.column("text").slice(x, y - x).to_pylist())
    if cell is not None:
        yield done()
    del sides
    pa.default_memory_pool().release_unused()  # workers outlive their tasks


def _joined(s: Scratch, members: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v): links among members (key, id, group, side): of each key, nodes of side 0 are compared with those of side 1."""
    sized = s.write(members.join(texts.select("id", "bytes"), "id"), "dedup-sized")
    parts = lambda side: F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("side") == side, F.col("bytes"))) / CELL_BYTES)).cast("int")
    cells = sized.groupBy("key").agg(parts(0).alias("n_a"), parts(1).alias("n_b"))
    hashed = F.xxhash64("id")
    many = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n: F.array(F.pmod(hashed, F.col(n)).cast("int"))
    left = F.col("side") == 0
    dealt = sized.join(cells, "key").withColumn("a", F.explode(F.when(left, own("n_a")).otherwise(many("n_a")))).withColumn("b", F.explode(F.when(left, many("n_b")).otherwise(own("n_b"))))
    full = dealt.select("key", "a", "b", "side", "id", "group").join(texts.select("id", "sig", "text"), "id").select("key", "a", "b", F.col("side").cast("int").alias("side"), "id", "group", "sig", "text")
    links = full.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "side").mapInArrow(_compare, "u long, v long")
    found = s.write(links, "dedup-links")
    s.drop(sized)
    return found


def classes(s: Scratch, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables (doc_id, n_shingles, node) of all rows and (node, component) of all nodes with shingles."""
    signed = s.write(sign(docs), "dedup-signed")
    rows = s.out(signed.select("doc_id", "n_shingles", "node"), "dedup-rows")
    full = signed.where("n_shingles > 0")
    named = s.write(full.groupBy("node").agg(F.min("doc_id").alias("id")), "dedup-nodes")
    nodes = full.join(named.withColumnRenamed("id", "doc_id"), ["node", "doc_id"]).select(F.col("doc_id").alias("id"), "sig", "bands")
    nodes = s.write(nodes, "dedup-node-signatures")
    s.drop(signed)

    bands = nodes.select("id", F.explode("bands").alias("key"))
    buckets = bands.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").drop("last")
    members = s.write(bands.join(buckets, "key").distinct(), "dedup-members")
    stars = members.where("id <> first").select("id", "first").distinct()
    sig = lambda name: nodes.select(F.col("id").alias(name), F.col("sig").alias(f"sig_{name}"))
    stars = stars.join(sig("id"), "id").join(sig("first"), "first").where(_agreeing(F.col("sig_id"), F.col("sig_first")) >= AGREE)
    stars = s.write(stars.select("id", "first").distinct(), "dedup-stars")
    wanted = members.select("id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").join(nodes.select("id", "sig"), "id").join(wanted, "id", "left_semi")
    texts = s.write(texts.select("id", "sig", F.octet_length("text").cast("long").alias("bytes"), "text"), "dedup-texts")
    s.drop(nodes)
    pivots = stars.select("first").distinct().select(F.col("first").alias("key"), F.col("first").alias("id"), F.col("first").alias("group"), F.lit(0).alias("side"))
    around = stars.select(F.col("first").alias("key"), "id", F.col("id").alias("group"), F.lit(1).alias("side"))
    links = _joined(s, pivots.unionByName(around), texts)
    groups = components(s, links)
    s.drop(stars)

    # Buckets of several groups, less their pivots, which all have been compared with.
    placed = members.where("id <> first").join(groups.withColumnsRenamed({"u": "id", "v": "group"}), "id", "left").select("key", "id", F.coalesce("group", "id").alias("group"))
    placed = s.write(placed, "dedup-placed")
    sizes = placed.groupBy("key", "group").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("x"), F.bit_xor(F.hash("id")).alias("y"))
    mixed = sizes.groupBy("key").agg(F.max_by("group", F.struct("n", "group")).alias("main"), F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.sum("x").alias("x"), F.bit_xor("y").alias("y")).where("groups > 1")
    # Buckets of the same nodes are one.
    mixed = mixed.groupBy("n", "x", "y").agg(F.min(F.struct("key", "main")).alias("b")).select("b.key", "b.main")
    around = placed.join(s.write(mixed, "dedup-mixed"), "key")
    both = around.select("key", "id", "group", F.explode(F.when(F.col("group") != F.col("main"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("side"))
    more = _joined(s, both, texts)
    if not more.isEmpty():
        groups = components(s, groups.unionByName(more))
    label = named.join(groups.withColumnsRenamed({"u": "id", "v": "least"}), "id", "left").select("node", F.coalesce("least", "id").alias("component"))
    return rows, s.out(label, "dedup-classes")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    with Scratch(docs.sparkSession) as s:
        rows, label = classes(s, docs)
    linked = rows.where("n_shingles > 0").join(label, "node").select("doc_id", "n_shingles", "component")
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    return linked.unionByName(alone).select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.col("component").isNull()).alias("kept"))


#: Ids that rows without an id of their own get begin here.
SPARE = 1 << 62


def _own_ids(s: Scratch, docs: DataFrame, own: str) -> tuple[DataFrame, bool]:
    """docs with a column `own`: doc_id, but a new number above SPARE for null ids and for all texts but one of an id; whether there are any such rows."""
    ids = docs.select(F.col("doc_id").cast("long").alias("d"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("t"))
    again = s.write(ids.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR d IS NULL").select("d"), "dedup-shared-ids")
    if again.isEmpty():
        return docs.withColumn(own, F.col("doc_id").cast("long")), False
    same = F.col("d").eqNullSafe(F.col("d_"))
    texts = ids.join(again.select(F.col("d").alias("d_")), same, "left_semi").distinct()
    first = texts.where("d IS NOT NULL").groupBy("d").agg(F.min("t").alias("first")).withColumnRenamed("d", "d_")
    texts = s.write(texts.join(first, same, "left").select("d", "t", (F.col("t") == F.col("first")).alias("stays")), "dedup-shared-texts")
    number = F.when(F.col("stays"), F.col("d")).otherwise(F.monotonically_increasing_id() + SPARE)  # the table is written: its rows' numbers stay
    texts = s.out(texts.select(F.col("d").alias("d_"), F.col("t").alias("t_"), number.alias("number")), "dedup-own-ids")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("d"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("t"))
    row = row.join(texts, same & (F.col("t") == F.col("t_")), "left").select("row", F.coalesce("number", "d").alias("own_"))
    return row.select(*[F.col(f"row.`{c}`") for c in docs.columns], F.col("own_").alias(own)), True


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that aren't kept; of rows that share id and text one stays."""
    own = free_name("own", docs)
    with Scratch(docs.sparkSession) as s:
        named, shared = _own_ids(s, docs, own)
        found = near_copies(named.select(F.col(own).alias("doc_id"), "text"))
        gone = s.out(found.where(~F.col("kept")).select(F.col("doc_id").alias(own)).distinct(), "dedup-gone")
    out = named.join(gone, own, "left_anti")
    if shared:
        out = out.dropDuplicates([own])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


#: The same by a join on shingles and reachability, for small tables.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), e AS (SELECT doc_id, md5_number(unnest(s)) AS g FROM s),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.r)
SELECT n.doc_id, n.n AS n_shingles, min(r.r) AS component_id, n.doc_id = min(r.r) AS kept FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n
"""
