"""Every operator and pipeline stage on nulls, empty and equal rows, ties, empty tables, and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import audit, dedup, lines, media, mixing, neighbours, packing, pages, phrases, pieces, pii, quality, toxicity

SF = "/root/testdata/sf0.001"
#: Names that the operators use within their plans, and names that only look internal.
NAMES = "row rid base text_ passages terms d uid l h at w f lost new key id sig group side a b skey size hash block n target rate copies rank copy all before __text __spans __uid __words __hash __key next kept source_size x score length".split()
A = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen."
RUN = " ".join(f"w{k}" for k in range(40)) + ". Mail a@b.example or +1 555 010 9999.\n"
ROWS = [
    (1, None, None), (2, "", "a"), (3, A, "a"), (3, A, "a"), (4, A, None), (None, "x", "b"), (None, RUN, "b"), (None, RUN, "b"), (5, "word " * 30_000, "b"), (6, " \n\t ", "b"),
    (7, RUN + "and more", None), (8, RUN + RUN, "a"), (8, "another text of the same id", "a"), (9, "\x01 \ud7ff \u0130", ""),
]


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({name: F.lit(f"own {name}") for name in NAMES} | {"n_chars": F.length("text").cast("long"), "lang": F.lit("en")})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").cache()


DIGESTS = {
    "dedup": lambda d, y: dedup.near_copies(d), "quality": lambda d, y: quality.digest(d, y), "media": lambda d, y: media.digest(d), "toxicity": lambda d, y: toxicity.digest(d, y),
    "mixing": lambda d, y: mixing.digest(d), "pii": lambda d, y: pii.digest(d), "lines": lambda d, y: lines.digest(d), "pieces": lambda d, y: pieces.digest(d),
}
FILTERS = {"keep_good": lambda d, y: quality.keep_good(d, y), "drop_copies": lambda d, y: dedup.drop_copies(d), "drop_repeats": lambda d, y: lines.drop_repeats(d), "sanitise": lambda d, y: pii.sanitise(d), "mix": lambda d, y: mixing.apply(d)}


@pytest.mark.parametrize("name", DIGESTS)
def test_digests(spark, labels, name):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    rows = DIGESTS[name](table(spark, ROWS), labels).collect()
    assert len(rows) == len(ROWS)
    assert sorted(map(str, rows)) == sorted(map(str, DIGESTS[name](plain, labels).collect()))
    assert DIGESTS[name](table(spark, []), labels).count() == 0


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_columns(spark, labels, name):
    docs = table(spark, ROWS)
    out = FILTERS[name](docs, labels)
    rows = out.collect()
    assert out.columns == docs.columns and all(r[c] == f"own {c}" for r in rows for c in NAMES)
    assert FILTERS[name](table(spark, []), labels).count() == 0


REPORTS = {"audit": lambda d, y: audit.audit(d, y), "phrases": lambda d, y: phrases.collocations(d)}


@pytest.mark.parametrize("name", REPORTS)
def test_reports(spark, labels, name):
    plain = table(spark, ROWS).select("doc_id", "text", "source", "lang")
    rows = REPORTS[name](table(spark, ROWS), labels).collect()
    assert rows and sorted(map(str, rows)) == sorted(map(str, REPORTS[name](plain, labels).collect()))
    assert REPORTS[name](table(spark, []), labels).count() == 0


def test_pages(spark):
    html = "<article><h1>Title</h1><p>" + "Some words of a text. " * 20_000 + "</p></article>"
    rows = [(1, "u", html), (1, "u", html), (None, None, None), (2, "", ""), (3, "u", "<p>\x00</p>"), (4, "u", "no tags at all, only words in a row")]
    plain = spark.createDataFrame(rows, "page_id long, url string, html string")
    named = plain.withColumns({n: F.lit(f"own {n}") for n in ("text", "n_chars", "n", "lang", "doc_id")})
    got = sorted(map(str, pages.extract(named).collect()))
    assert len(got) == len(rows) and got == sorted(map(str, pages.extract(plain).collect()))
    assert {r.n_chars for r in pages.extract(plain).where("page_id = 1").collect()} == {len("Title\n\n") + 22 * 20_000 - 1}
    assert pages.extract(plain.limit(0)).count() == 0


def test_neighbours(spark):
    """Ties, repeated and null ids, vectors that take no part, one candidate only, clashing names."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [2.0, 0.0]), (7, [3.0, 0.0]), (5, [3.0, 0.0]), (6, [0.0, 1.0]), (9, None), (10, [0.0, 0.0]), (11, [nan, 1.0]), (12, [inf, 1.0]), (100, [1.0, nan]), (150, None)]
    vectors = spark.createDataFrame([(k, v and [float(x) for x in v]) for k, v in rows], "vec_id long, vector array<float>")
    column = spark.read.parquet(f"{SF}/embeddings.parquet").columns
    vectors = vectors.toDF("vec_id", next(c for c in column if c != "vec_id" and dict(spark.read.parquet(f"{SF}/embeddings.parquet").dtypes)[c].startswith("array")))
    named = vectors.withColumns({n: F.lit(f"own {n}") for n in ("query_id", "rank", "score", "dim", "hash", "qb", "cb", "v", "norm", "block")})
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.search(named).collect())
    assert [x[:3] for x in got] == [(0, 1, 5), (0, 2, 7), (0, 3, 50), (0, 4, 6), (50, 1, 0), (50, 2, 5), (50, 3, 7), (50, 4, 6)]
    assert [x[3] for x in got] == [1.0, 1.0, 1.0, 0.0] * 2
    assert neighbours.search(vectors.limit(0)).count() == 0 and neighbours.search(vectors.where("vec_id = 50")).count() == 0


def test_packing(spark):
    rows = packing.digest(table(spark, ROWS)).collect()
    assert len({(r.doc_id, r.start) for r in rows if r.start == 0}) == len({r[0] for r in ROWS}) and sum(r.start == 0 for r in rows) == len(ROWS)
    assert packing.pack(table(spark, [])).count() == 0


def test_stages_on_an_empty_table(spark):
    docs = table(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_stages_on_odd_rows(spark):
    docs = table(spark, ROWS)
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, SF)
    assert docs.count()
