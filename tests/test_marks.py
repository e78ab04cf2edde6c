"""Marks in texts: two letters are looked at before words are, and pages that can't hold a pair aren't searched for one."""

import random

from pyspark.sql import functions as F

from tessera.functions import matcher
from tessera.operators import identifiers


def test_words_are_found_behind_two_of_their_letters(spark):
    dice = random.Random(3)
    for leads in ({"ab-", "a.c", "-a", "b", "ba.c"}, {"ab-", "a.c", "-a", "ba.c"}):
        texts = ["".join(dice.choices("abcAB.-\n\U0001f600", k=dice.randrange(12))) for _ in range(300)] + ["", "b", "-", "a.", "-A"]
        df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string").withColumn("found", matcher.leads_in(F.col("text"), leads))
        for r in df.collect():
            at = [max((x for x in leads if r.text.lower().startswith(x, k)), key=len, default=None) for k in range(len(r.text))]
            assert {x.lower() for x in r.found} == {x for x in at if x}
        plan = df._jdf.queryExecution().analyzed().toString()
        assert "(?i)[" in plan and "(?i)(?=" not in plan


def test_pages_without_an_id_are_not_searched_for_installs(spark):
    own = "data-website-id='01234567-89ab-cdef-0123-456789abcdef'"
    rows = [(1, "<b src='/umami.js'>"), (2, f"<b src='/umami.js' {own}>"), (3, f"<b {own}>"), (4, None), (5, f"<b {own.upper()} src='/umami.js'>")]
    found = identifiers.umami_pairs(spark.createDataFrame(rows, "page_id long, html string"))
    assert [(r.page_id, r.src) for r in found.collect()] == [(2, "/umami.js")]
    assert "data-website-id=)" in found._jdf.queryExecution().analyzed().toString()
