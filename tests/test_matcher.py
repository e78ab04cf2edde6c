"""The one-pass matcher: no match lost, whatever marks overlap; keywords and account ids against patterns tried one by one."""

import random
import re

from pyspark.sql import functions as F

from tessera.functions import matcher
from tessera.operators import identifiers, scoring
from tessera.registry import ACCOUNT_IDS, KEYWORDS, PREFIX


def test_trie_finds_the_longest_word():
    words = {"a", "ab", "abc", "abd", "b.c", "xyz", "x+", "b"}
    pattern = re.compile(matcher.trie(words))
    for text in [*words, "abz", "abcd", "b.d", "x+y"]:
        assert pattern.match(text)[0] == max((w for w in words if text.startswith(w)), key=len)
    assert not pattern.match("yz") and re.fullmatch(matcher.trie({"one"}), "one")


def test_every_rule_whose_mark_is_there_is_tried(spark):
    rules = [("cat", 1), ("(?i)category", 2), ("atego", 3), ("cats?", 4), ("[a-z]+[0-9]", 5), ("gory-(\\d+)", 6), ("dog|bird", 7)]
    texts = spark.createDataFrame([(1, "a CATEGORY-7"), (2, "cat"), (3, "none"), (4, ""), (5, None), (6, "Gory-9 cat cat")], "id int, text string")
    rows = matcher.tried(texts, "text", rules, "pattern string, n int").collect()
    tried = {}
    for r in rows:
        tried.setdefault(r.id, []).append(r.n)
    always = [5, 7]  # no letters that each match holds
    assert {k: sorted(v) for k, v in tried.items()} == {1: [1, 2, 3, 4, 5, 6, 7], 2: [1, 4, *always], 3: always, 4: always, 6: [1, 4, 5, 6, 7]}


def test_keywords_are_those_of_each_pattern(spark):
    dice = random.Random(8)
    words = [re.sub(r"\\s\*", " ", re.sub(r"\(\?:([^|)]*)[^)]*\)\??|\\", r"\1", p)).replace("?", "") for x in KEYWORDS.values() for p in x]
    words += ["wellness", "Relationship", "massages", "shellfish", "pornographic", "XXX", "18+", "nothing", "Äwellness", "ai companion"]
    texts = [(k, " ".join(dice.choices(words, k=dice.randrange(25)))) for k in range(200)]
    got = sorted((r.page_id, r.pattern, r.severity, r.hits, r["first"]) for r in scoring.keyword_hits(spark.createDataFrame(texts, "page_id long, text string"), "text").withColumnRenamed("keyword", "pattern").collect())
    want = []
    for k, text in texts:
        for severity, patterns in KEYWORDS.items():
            for p in patterns:
                found = [m[0] for m in re.finditer(rf"(?ai)\b(?:{p})\b", text)]
                if found:
                    want.append((k, p, severity, len(found), found[0]))
    assert got == sorted(want) and len(got) > 300


def test_account_ids_are_those_of_each_pattern(spark):
    snippets = ['"G-ABC1234567"', "GTM-ABCD12", "ca-pub-1234567890123", "hotjar.com/x 123456", "HJID: 1", "hjid:654321", "fbq('init', '123456789012345')", '"AW-123456789"', "pk_live_" + "a" * 24, "clarity.ms/tag/abc", "CLARITY.MS/TAG/ABC", "'0x4AAAAAAAabcdefgh'", "idsite=7", "gtm-abcd12"]
    dice = random.Random(9)
    pages = [(k, " <p> ".join(dice.choices(snippets, k=dice.randrange(8)))) for k in range(150)] + [(999, None), (1000, "")]
    got = sorted((r.page_id, r["name"], r.id) for r in identifiers.account_ids(spark.createDataFrame(pages, "page_id long, html string")).collect())
    column = spark.createDataFrame(pages, "page_id long, html string").where("html IS NOT NULL").select("page_id", F.explode(identifiers.account_hits(F.col("html"))).alias("h"))
    assert got == sorted((r.page_id, r.h["name"], r.h.id) for r in column.collect()) and len(got) > 200
    want = {(k, n, PREFIX.get(n, "") + m[1]) for k, h in pages for n, p in ACCOUNT_IDS if n != "Umami Script Source" for m in re.finditer(p, h or "", re.A) if m[1]}
    assert set(got) == want
