"""Many patterns at once: the letters that every match of a pattern holds are looked for in each text, which costs far less than a
pattern; only patterns whose letters are there are tried, each as a row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import markup
from tessera.registry import java, literal, runs


#: Letters by how rare they are in pages; all others are common.
_RARE, _FAIR = "+-0123456789:?_{jqxz", "./(=bfgkmpvwy"


def trie(words: set[str]) -> str:
    """A pattern of the longest of some words at a place, each common beginning written once."""
    heads: dict[str, set[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], set()).add(w[1:])
    parts = [re.escape(c) + (trie(rest) if rest != {""} else "") for c, rest in sorted(heads.items())]
    body = parts[0] if len(parts) == 1 and "" not in words else f"(?:{'|'.join(parts)})"
    return body + "?" if "" in words else body


def mark_of(pattern: str) -> str:
    """Letters, in lower case, of which each match holds a run; empty if there are none to tell."""
    return literal(pattern).lower()


def lead(mark: str) -> str:
    """The end of a mark, of three letters at least, that begins with its rarest letter: at few places is more than that letter looked at."""
    rare = [next(k for k, letters in enumerate((_RARE, _FAIR, mark)) if c in letters) for c in mark]
    return mark[min(range(max(1, len(mark) - 2)), key=lambda i: (rare[i], i)) :]


#: Letters from the rarest in pages on; all others are common.
_SELDOM = "_{+?(j:kqz-x0123456789=wyfgb"


def rare_lead(pattern: str) -> str:
    """Letters, in lower case, that each match of a pattern holds: of its longest run, if that will do, from the letter before a rare one on, three
    if there are; empty if there is no rare letter."""
    places = [(x != mark_of(pattern), x[k - 1 :], _SELDOM.index(x[k])) for x in map(str.lower, runs(pattern)) for k in range(1, len(x)) if x[k] in _SELDOM]
    return min((len(word) < 3, other, rank, word) for other, word, rank in places)[3] if places else ""


def pairs_in(text: Column, leads: set[str]) -> Column:
    """As `leads_in`, for words of two letters or more whose second letter is rare: only from such letters is looked back."""
    heads, seconds = sorted({x[0] for x in leads}), sorted({x[1] for x in leads})
    some = lambda letters: f"[{''.join(map(re.escape, letters))}]"
    groups = [heads[k : k + 5] for k in range(0, len(heads), 5)]
    words = "|".join(f"(?={some(g)})" + trie({x for x in leads if x[0] in g}) for g in groups)
    both = f"{some(heads)}{some(seconds)}"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?i){some(seconds)}(?<={both})(?<=(?=({words})){both})"), F.lit(1)))


def holds(found: Column, lead: str) -> Column:
    """Whether a lead is among those of `pairs_in`; one that is found stands for those that it begins with, too."""
    return F.exists(found, lambda x: F.lower(x).startswith(lead))


def leads_in(text: Column, leads: set[str]) -> Column:
    """Those of some words in lower case that a text holds in any case, by one pattern for all of them; of words at one place only the
    longest. Java tries alternatives one after the other, so a letter leads to those of five first letters, and two letters are
    looked at before any of them: a look-ahead at each place costs more than a class that ends there."""
    heads, seconds = sorted({x[0] for x in leads}), sorted({x[1:2] for x in leads})
    some = lambda letters: f"[{''.join(map(re.escape, letters))}]"
    groups = [heads[k : k + 5] for k in range(0, len(heads), 5)]
    words = "|".join(f"(?={some(g)})" + trie({x for x in leads if x[0] in g}) for g in groups)
    behind = f"(?={some(seconds)})" if all(seconds) else ""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?i){some(heads)}{behind}(?<=(?=({words})){some(heads)})"), F.lit(1)))


def tried(texts: DataFrame, text: str, rules: list[tuple], schema: str, inner: list[str] | None = None) -> DataFrame:
    """Rows of texts, each with each rule (pattern first) that may match its column `text`, a regex for Spark and the rule's number:
    rules whose mark the text holds in any case, and those without a mark. Null texts give no rows.

    inner: patterns to take the marks from, where the rules' own hide them in a group.
    """
    own = [mark_of(p) for p in inner or [r[0] for r in rules]]
    none = F.array().cast("array<int>")
    always = F.when(F.col(text).isNotNull(), F.array(*[F.lit(n) for n, x in enumerate(own) if not x]).cast("array<int>"))
    marks = sorted({x for x in own if x})
    # A lead that is found stands for those that it begins with, too.
    of = [F.struct(F.lit(lead(m)).alias("lead"), F.lit(f"(?i){re.escape(m)}").alias("mark"), F.array(*[F.lit(n) for n, x in enumerate(own) if x == m]).alias("numbers")) for m in marks]
    holds = lambda found, x: F.exists(found, lambda y: F.lower(y).startswith(x["lead"])) & F.rlike(F.col(text), x["mark"])
    held = lambda found: F.flatten(F.transform(F.filter(F.array(*of), lambda x: holds(found, x)), lambda x: x["numbers"]))
    numbers = F.concat(always, markup.let(leads_in(F.col(text), {lead(m) for m in marks}), held) if marks else none)
    table = texts.sparkSession.createDataFrame([(n, java(r[0]), *r) for n, r in enumerate(rules)], f"rule int, regex string, {schema}")
    return texts.withColumn("rule", F.explode(numbers)).join(F.broadcast(table), "rule")  # as many rows as rules
