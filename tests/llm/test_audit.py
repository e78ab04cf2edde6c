"""The filter audit against SQL, against applying the filters one after another, and on odd rows."""

from collections import defaultdict
from itertools import permutations

import duckdb
import pytest

from tessera.llm import audit

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, mask string"
LONG = " ".join(f"w{k}" for k in range(60))
ROWS = [
    (1, None, None, "own"), (2, "", "a", "own"), (3, "", "a", "own"), (4, LONG, "a", "own"), (5, LONG, "", "own"), (5, LONG, "", "own"), (6, LONG + " #", "b", None), (7, LONG.upper(), "b", None),
    (8, "word " * 30_000, "b", None), (9, "x y z", "b", None), (None, LONG, "b", None), (None, "", None, None), (4, "other", "c", None), (4, LONG, "a", None), (10, "Ab cd", "c", None), (11, "a\x1cb \x85c", "c", None),
]
LABELS = [(1, 1, 0), (1, 0, None), (3, 1, 1), (5, 0, 1), (6, 1, 1), (None, 1, 1), (99, 1, 1), (8, None, 1)]


def plain(rows, labels):
    """Filters applied from left to right, row by row."""
    fails = []
    for doc_id, text, source, _ in rows:
        text = text or ""
        words = [w for w in text.translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
        f = {c for c, x in zip("ABCD", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), any(c in "#$%&*|" for c in text))) if x}
        if doc_id is not None and any(o is not None and o < doc_id and (t or "") == text for o, t, *_ in rows):
            f.add("E")
        fails.append((source or "", f, *(any(doc_id is not None and x[0] == doc_id and x[k] == 1 for x in labels) for k in (1, 2))))
    out, shapley = {}, defaultdict(int)
    for part in {x[0] for x in fails}:
        for order in map("".join, permutations("ABCDE")):
            left = [x for x in fails if x[0] == part]
            for step, c in enumerate(order, 1):
                gone = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                own = [x for x in fails if x[0] == part and c in x[1]]
                shapley[part, c] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(own) - len(gone), sum(x[1] == {c} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_equals_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = sorted(con.execute(audit.SQL).fetchall())
    assert sorted(map(tuple, audit.audit(*(spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))).collect())) == want and want


def test_equals_filters_applied_in_turn(tables):
    assert sorted(map(tuple, audit.audit(*tables).collect())) == plain(ROWS, LABELS)


def test_copies_meet_after_the_shuffle(tables, monkeypatch):
    """The same if tasks hold one text at a time and rows lie in many partitions."""
    docs, labels = tables
    rows = []
    monkeypatch.setattr(audit, "HELD_BYTES", 1)
    for k in range(4):
        sent = list(audit._combined((r.doc_id, r.source or "", r.text or "", hash(r.text or "")) for r in docs.collect()[k::4]))
        rows += sent
    got = sorted(map(str, audit._decided(sorted(rows, key=lambda x: x[0]))))
    monkeypatch.undo()
    want = [str((r.doc_id, r.part, r.mask, 1)) for r in audit.failures(docs).collect() for _ in range(r.n)]
    assert sorted(x for row in got for x in [row.rsplit(",", 1)[0]] * int(row.rsplit(",", 1)[1][:-1])) == sorted(x.rsplit(",", 1)[0] for x in want)


def test_texts_of_one_hash_are_told_apart():
    rows = [(7, ("one", 5, {("a", 0): 1})), (7, ("two", 3, {("a", 0): 1})), (7, ("one", 2, {("b", 1): 2})), (7, ("two", 4, {("a", 0): 1})), (8, (None, (9, "a", 16), 1))]
    assert sorted(audit._decided(rows)) == [(2, "b", 1, 2), (3, "a", 0, 1), (4, "a", 16, 1), (5, "a", 16, 1), (9, "a", 16, 1)]


def test_lost_documents_are_noticed(tables):
    docs, labels = tables
    counted = audit.vectors(docs, labels)
    audit.check_whole(docs, counted)
    for other in (docs.where("doc_id IS NULL OR doc_id <> 9"), docs.where("coalesce(source, '') <> 'c'"), docs.limit(0)):
        with pytest.raises(RuntimeError, match="documents counted"):
            audit.check_whole(other, counted)


def test_empty_tables(tables):
    docs, labels = tables
    assert audit.audit(docs.limit(0), labels).count() == 0
    assert {r.good_lost for r in audit.audit(docs, labels.limit(0)).collect()} == {0}
