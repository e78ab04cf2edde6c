"""Collocations against SQL and against a plain count, on odd rows, large numbers and other lengths."""

import random
import re
from collections import Counter

import duckdb
import pytest

from tessera.llm import phrases

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, phrase string"


def plain(rows, max_n=3, least=10, share=50, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang, _ in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall("[^ \t]+", piece)
            n[lang or "und" if lang != "" else ""] += len(words)
            for k in range(1, max_n + 1):
                f.update((lang or "und" if lang != "" else "", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in candidates.items():
        if any(y != w and len(y) > len(w) and other == lang and 100 * b >= share * a and any(y[i : i + len(w)] == w for i in range(len(y))) for (other, y), b in candidates.items()):
            continue
        score, _, l, r = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, l, r, n[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    rank, ranked = Counter(), []
    for lang, *rest in out:
        rank[lang] += 1
        if rank[lang] <= top:
            ranked.append((lang, rank[lang], *rest))
    return ranked


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def odd():
    dice, words = random.Random(3), ["a", "B", "b", "Ä", "ä", "é", "\U0001f600", "ﬁ", "x\x1cy", "\x85", "c", "İ", "the", "of", "%"]
    rows = [(k, "".join(w + dice.choice([" ", "  ", "\t", ", ", ".", "\n", " ", " "]) for w in dice.choices(words, range(1, len(words) + 1), k=dice.randrange(40))), dice.choice(["en", "de", None, "und", ""]), "own") for k in range(160)]
    rows += [(1, None, "en", None), (1, "", "en", None), (None, "a b c a b c", "fr", None), (5, "new york city " * 20_000, "en", None), (6, "solo", "xx", None), (7, " \t\n.", None, None)]
    return rows + rows[:20]


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert rows_of(phrases.collocations(spark.read.parquet(f"{SF}/documents.parquet"))) == sorted(con.execute(phrases.SQL).fetchall()) != []


@pytest.mark.parametrize("kind", [{}, {"max_n": 4, "least": 3}, {"max_n": 2, "least": 2, "top": 5}, {"max_n": 5, "least": 1, "share": 80, "top": 40}])
def test_equals_a_plain_count(spark, odd, kind):
    rows = [r for r in odd if len(r[1] or "") < 9000 or kind.get("least", 10) > 1]
    assert rows_of(phrases.collocations(spark.createDataFrame(rows, SCHEMA), **kind)) == sorted(plain(rows, **kind)) != []


@pytest.mark.parametrize("size", [1, 7, 40])
def test_texts_read_in_parts_count_the_same(spark, odd, monkeypatch, size):
    def counted(data, max_n):
        total = Counter()
        for names, times in phrases.phrases_of(data, max_n):
            total.update(dict(zip(names.to_pylist(), times.tolist())))
        return total

    data = phrases.END.join((t or "").encode() for _, t, *_ in odd if len(t or "") < 9000).translate(phrases.FOLD)
    want = {n: counted(data, n) for n in (1, 2, 3, 5)}
    monkeypatch.setattr(phrases, "PART_BYTES", size)
    assert b"".join(phrases.parts(data, size)) == data
    assert {n: counted(data, n) for n in want} == want and all(want.values())


def test_ranking_within_shares_keeps_the_first(spark, monkeypatch, odd):
    docs = spark.createDataFrame(odd, SCHEMA)
    want = rows_of(phrases.collocations(docs, least=2, top=7))
    monkeypatch.setattr(phrases, "SHARES", 1)
    assert rows_of(phrases.collocations(docs, least=2, top=7)) == want


def test_products_beyond_64_bits(spark):
    a, l, r = 3 * 10**14 + 1, 10**15 - 7, 9 * 10**14 + 11
    f = spark.createDataFrame([("en", "x", l), ("en", "y", r), ("en", "x y", a)], "lang string, phrase string, f long")
    got = phrases.scored(f.where("phrase = 'x y'").withColumnRenamed("f", "a"), f).collect()
    assert [(x.a, x.l, x.r, x.score) for x in got] == [(a, l, r, 10**6 * a * a // (l * r))]


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_words_of_a_part_are_no_objects():
    import tracemalloc

    data = b"ab cd " * 200_000 + phrases.END + b" x "
    tracemalloc.start()
    tokens = phrases._tokens(data)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3 * len(data) and len(tokens) == 400_002 and tokens[-2:].to_pylist() == [phrases.END, b"x"]
    assert phrases._tokens(b"").to_pylist() == [] == phrases._tokens(b"  ").to_pylist()
